"""Text expressions, all of them built-in functions that stay in generated code."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the ranking tokenizer drops.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of",
    "with", "by", "is", "are", "was", "were", "be", "been", "being", "have",
    "has", "had", "do", "does", "did", "will", "would", "could", "should",
)

#: White space as Java's \s without (?U) and RE2 see it.
_SPACE = r"\s"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+$", "")


def blank(text: Column) -> Column:
    """Null, empty or nothing but white space."""
    return ~F.coalesce(text.rlike(r"\S"), F.lit(False))


def words(text: Column) -> Column:
    """Parts between white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), rf"{_SPACE}+"), "")


def rank_parts(text: Column) -> Column:
    """Lower-cased runs of letters, digits and `_`, some of them empty: ranking tokens and what is none."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")


def is_rank_token(part: Column) -> Column:
    """Whether a part has two characters or more and isn't a stop word."""
    return (F.length(part) >= 2) & ~part.isin(*STOP_WORDS)


def rank_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and `_`, of two characters or more, without stop words."""
    return F.filter(rank_parts(text), is_rank_token)


def sentences(text: Column) -> Column:
    return F.filter(F.split(stripped(text), rf"(?<=[.!?]){_SPACE}+"), lambda x: x != "")


def normalized_answer(text: Column) -> Column:
    """Lower case, only a-z, 0-9 and single blanks."""
    kept = F.regexp_replace(F.lower(text), rf"[^a-z0-9{_SPACE}]", "")
    return F.trim(F.regexp_replace(kept, rf"{_SPACE}+", " "))


def exact_match(prediction: Column, reference: Column) -> Column:
    return (normalized_answer(prediction) == normalized_answer(reference)).cast("double")


def held(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often and within whatever lambda it's used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """The same value, but not to be copied: filters and projections above would otherwise repeat what makes it."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def numbered(items: Column) -> Column:
    """Each element of an array of texts with its number among its equals: multisets as sets, by one sort."""

    def each(kept: Column) -> Column:
        first = lambda x, i: F.when((i == 0) | (F.get(kept, i - 1) != x), i)
        return held(F.filter(F.transform(kept, first), lambda i: i.isNotNull()), lambda starts: F.flatten(F.transform(starts, lambda at, j: run(kept, starts, at, j))))

    def run(kept: Column, starts: Column, at: Column, j: Column) -> Column:
        size = F.coalesce(F.get(starts, j + 1), F.size(kept)) - at
        word = F.get(kept, at)
        return F.when(size == 1, F.array(word)).otherwise(
            F.transform(F.sequence(F.lit(1), size), lambda n: F.when(n == 1, word).otherwise(F.concat(word, F.lit("\u0000"), n.cast("string"))))
        )

    return held(F.sort_array(items), each)


def shared_count(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays of texts as multisets, in the time of sorting them."""
    return F.size(F.array_intersect(numbered(a), numbered(b)))


def _f1(a: Column, b: Column, empty: float) -> Column:
    """empty: the score of two empty arrays; one that is empty, or null, scores 0. As in SQL, words against null have none."""

    def score(x: Column) -> Column:
        n, m = F.size(x["a"]), F.size(x["b"])
        ratio = lambda s: held(F.struct((s / n).alias("p"), (s / m).alias("r")), lambda v: 2 * v["p"] * v["r"] / (v["p"] + v["r"]))
        scored = held(shared_count(x["a"], x["b"]).cast("double"), lambda s: F.when(s == 0, 0.0).otherwise(ratio(s)))
        known = F.when((n == 0) & (m == 0), F.lit(empty)).when((n == 0) | (m == 0), 0.0).otherwise(scored)
        return F.when((n > 0) & x["b"].isNull(), F.lit(None)).otherwise(F.coalesce(known, F.lit(0.0)))

    return held(F.struct(a.alias("a"), b.alias("b")), score)


def answer_f1(prediction: Column, reference: Column) -> Column:
    """Token F1 of normalised answers; 1 if both are empty, 0 if one is."""
    part = lambda t: F.filter(F.split(normalized_answer(t), " "), lambda x: x != "")
    return _f1(part(prediction), part(reference), 1.0)


def prompt_f1(reference: Column, candidate: Column) -> Column:
    """Token F1 over runs of a-z and 0-9; 0 if either has none."""
    part = lambda t: F.regexp_extract_all(F.lower(t), F.lit("([a-z0-9]+)"), 1)
    return _f1(part(candidate), part(reference), 0.0)


def cell_text(text: Column) -> Column:
    """A cell's text on one line, without control characters, at most 500 characters."""
    flat = F.trim(F.regexp_replace(text, rf"{_SPACE}+", " "))
    return F.substring(F.trim(F.regexp_replace(flat, r"[\x00-\x1F]", "")), 1, 500)


def html_text(html: Column) -> Column:
    """Tags become blanks, white space is squeezed; script bodies stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), rf"{_SPACE}+", " "))


def table_id(example_id: Column, question: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", example_id.cast("string"), question).cast("binary")), 1, 12)


def ascii_title(title: Column) -> Column:
    """A title without parentheses and without characters beyond ASCII."""
    plain = F.regexp_replace(F.regexp_replace(title, rf"{_SPACE}*\([^)]*\){_SPACE}*", " "), r"[^\x00-\x7F]+", " ")
    return F.trim(F.regexp_replace(plain, rf"{_SPACE}+", " "))


def numeric_looking(text: Column) -> Column:
    return F.regexp_replace(text, "[.-]", "").rlike("^[0-9]+$")


def number(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default))


def stable_choice(options: Sequence[str], seed: Column) -> Column:
    """One of the options, the same for the same seed."""
    if not options:
        return F.lit("")
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(F.xxhash64(seed), F.lit(len(options))) + 1).cast("int"))


#: Markup that makes a text table-like by itself.
TABLE_MARKS = ("<table", "<th>", "<td>", "<tr>", "colspan", "rowspan")


def table_like(text: Column) -> Column:
    """Whether a text looks like a table: markup, a list of three, separators over three lines, or lines of like length."""
    low = F.lower(text)
    marked = F.exists(F.array(*[F.lit(m) for m in TABLE_MARKS]), lambda m: F.contains(low, m))
    listed = F.regexp_count(low, F.lit("<li>")) >= 3
    lines = F.split(stripped(text), "\n")
    separated = (F.size(lines) >= 3) & (F.contains(text, F.lit("\t")) | (F.regexp_count(text, F.lit(r"\|")) >= 4))
    counts = F.filter(F.transform(F.slice(lines, 1, 10), lambda x: F.size(words(x))), lambda n: n >= 3)
    mean = F.aggregate(counts, F.lit(0), lambda a, n: a + n).cast("double") / F.size(counts)
    alike = F.size(F.filter(counts, lambda n: F.abs(n - mean) <= mean * 0.5)) >= 3
    return F.coalesce(marked | listed | separated | ((F.size(lines) >= 4) & (F.size(counts) >= 3) & alike), F.lit(False))
