"""Tables in HTML: one Arrow-batched parse gives cells, built-in expressions do the rest."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: found: whether there is a table; rows: its rows and cells; title: what the markup calls it.
PARSED = "found boolean, rows array<array<struct<head:boolean,text:string>>>, title string"
_KIND = f"struct<{PARSED.replace(' array', ':array').replace(' string', ':string').replace(' boolean', ':boolean')}>"
#: Rows of the first table that are taken; the rest of a text is read on only for its title.
MOST_ROWS = 100
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = frozenset(("script", "style", "template"))


class _Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: dict[str, str | None]) -> None:
        self.name, self.attributes, self.children = name, attributes, []


class _Tree(HTMLParser):
    """A tree in which an element stays open until its own end tag, or that of one around it, comes.

    It holds the first table until its first rows are closed, and head cells and captions that may be the title, those
    outside of that table at the root in document order; so memory follows what is taken, not the length of a text.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [_Node("", {})]
        self.counts = {"table": 0, "tr": 0, "th": 0, "caption": 0}
        # Places among the open elements: the first table, its first rows, the outermost title kept outside of it.
        self.table, self.rows, self.kept = None, [], None

    def _add(self, node: _Node, opens: bool) -> None:
        name, place = node.name, len(self.open)
        whole = self.table is not None or self.kept is not None
        title = name == "caption" and not self.counts[name] or name == "th" and (not self.counts[name] or "colspan" in node.attributes)
        first = name == "table" and not self.counts[name]
        if whole or title or first:
            self.open[-1 if whole else 0].children.append(node)
        if opens:
            if first:
                self.table = place
            elif name == "tr" and self.table is not None and self.counts["tr"] < MOST_ROWS:
                self.rows.append(place)
            if title and self.kept is None:
                self.kept = place
            self.open.append(node)
        if name == "tr" and self.table is None:
            return
        if name in self.counts:
            self.counts[name] += 1

    def handle_starttag(self, tag, attrs):
        self._add(_Node(tag, dict(attrs)), tag not in _VOID)

    def handle_startendtag(self, tag, attrs):
        self._add(_Node(tag, dict(attrs)), False)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                while self.rows and self.rows[-1] >= i:
                    self.rows.pop()
                if self.table is not None and (self.table >= i or self.counts["tr"] >= MOST_ROWS and not self.rows):
                    self.table = None
                if self.kept is not None and self.kept >= i:
                    self.kept = None
                return

    def handle_data(self, data):
        if self.table is not None or self.kept is not None:
            self.open[-1].children.append(data)


def tree(html: str) -> _Node:
    parser = _Tree()
    parser.feed(html)
    parser.close()
    return parser.open[0]


def all_below(node: _Node, names: tuple[str, ...]) -> list[_Node]:
    """Elements of these names in document order, at any depth."""
    out, stack = [], list(reversed(node.children))
    while stack:
        item = stack.pop()
        if isinstance(item, _Node):
            if item.name in names:
                out.append(item)
            stack.extend(reversed(item.children))
    return out


def shown(node: _Node, separator: str = "") -> str:
    out, stack = [], list(reversed(node.children))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item.strip() if separator else item)
        elif item.name not in _HIDDEN:
            stack.extend(reversed(item.children))
    return separator.join(x for x in out if x) if separator else "".join(out)


def clean(text: str) -> str:
    flat = " ".join(text.split())
    return "".join(c for c in flat if ord(c) >= 32).strip()[:500]


def title(root: _Node) -> str | None:
    """The first spanning head cell of more than three characters, else the caption, else a long first head cell."""
    heads = all_below(root, ("th",))
    for head in heads:
        if "colspan" in head.attributes:
            said = " ".join(shown(head, " ").split())
            if len(said) > 3:
                return said
    for node in all_below(root, ("caption",))[:1]:
        if said := " ".join(shown(node, " ").split()):
            return said
    said = " ".join(shown(heads[0], " ").split()) if heads else ""
    return said if len(said) > 20 else None


def parse(html: str | None, normalize_tags: bool = False) -> dict | None:
    """What is found in a text; the title is read from mended tags, the rows only if asked for."""
    if html is None:
        return None
    try:
        mended = re.sub(r"<(\w+)_([^>]+)>", r"<\1 \2>", html)
        first = tree(mended)
        named = title(first)
        root = first if normalize_tags or mended == html else tree(html)
    except (AssertionError, RecursionError, ValueError):
        return None
    found = all_below(root, ("table",))
    rows = [
        [
            {"head": c.name == "th", "text": clean(shown(c))} for c in all_below(r, ("td", "th"))
        ] for r in all_below(found[0], ("tr",))[:MOST_ROWS]
    ] if found else []
    return {"found": bool(found), "rows": rows, "title": named}


#: What a regular table's texts are made of: no markup, no white space but blanks, nothing that parsers treat in a way of their own.
_PLAIN = r"[ -%'-;=?-~\u00C0-\u024F]"
#: All repeats are possessive, which Java takes in a loop, so long tables need no deep stack.
_REGULAR = rf"^<table>(?:<caption>{_PLAIN}*+</caption>)?+(?:<tr>(?:<td>{_PLAIN}*+</td>|<th>{_PLAIN}*+</th>)++</tr>)++</table>$"


def regular(html: Column) -> Column:
    """Whether a text is one table of plain rows and cells, with a caption or without, and nothing else."""
    return html.rlike(_REGULAR)


def _regular_parse(html: Column) -> Column:
    """The parse of a regular table, by splitting its text."""
    squeezed = lambda x: F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, " {2,}", " ")).otherwise(x)
    flat = lambda x: F.substring(F.trim(squeezed(x)), 1, 500)
    cell = lambda c: F.struct(c.startswith("h").alias("head"), flat(F.substr(c, F.lit(3))).alias("text"))
    # The first rows, cut before they are split: a text may hold many more.
    body = F.substring_index(html, "</tr>", MOST_ROWS)
    rows = F.transform(
        F.slice(F.split(body, "<tr>"), 2, MOST_ROWS),
        lambda r: F.transform(F.regexp_extract_all(r, F.lit("<t([dh]>[^<]*+)"), F.lit(1)), cell),
    )
    caption = flat(F.regexp_extract(html, "^<table><caption>([^<]*)</caption>", 1))
    first = flat(F.regexp_extract(html, "<th>([^<]*)</th>", 1))
    title = F.when(caption != "", caption).when(F.length(first) > 20, first)
    return F.struct(F.lit(True).alias("found"), rows.alias("rows"), title.alias("title")).cast(_KIND)


def _parsed(plain: Column, html: Column, normalize_tags: bool) -> Column:
    """Texts in which plain holds are split by expressions; the parser gets nulls for them, of which it makes no rows."""
    cell = pa.struct([("head", pa.bool_()), ("text", pa.string())])
    kind = pa.struct([("found", pa.bool_()), ("rows", pa.list_(pa.list_(cell))), ("title", pa.string())])

    @F.arrow_udf(PARSED)
    def run(texts: pa.Array) -> pa.Array:
        if texts.null_count == len(texts):
            return pa.nulls(len(texts), kind)
        return pa.array([parse(t, normalize_tags) for t in texts.to_pylist()], kind)

    other = run.asNondeterministic()(F.when(~plain, html))
    none = F.struct(*[F.lit(None).alias(n) for n in ("found", "rows", "title")]).cast(_KIND)
    # Not to be copied: filters and projections above would otherwise repeat the parse.
    return tx.once(F.when(plain, _regular_parse(html)).otherwise(F.coalesce(other, none)))


def parsed(html: Column, normalize_tags: bool = False) -> Column:
    """Regular tables are split by expressions; the rest goes to the parser."""
    return _parsed(F.coalesce(regular(html), F.lit(False)), html, normalize_tags)


def with_parsed(tables: DataFrame, html: str, name: str, normalize_tags: bool = False) -> DataFrame:
    """Adds the parse of a text column; what is regular is found once, for the parser and for the expressions."""
    df = tables.withColumn("_regular", tx.once(F.coalesce(regular(F.col(html)), F.lit(False))))
    return df.withColumn(name, _parsed(F.col("_regular"), F.col(html), normalize_tags)).drop("_regular")


def linearized(table: Column, html: Column) -> Column:
    """Cells that show something joined by ` | `, rows by ` || `; the plain text where there is no table."""
    line = lambda r: F.array_join(F.transform(F.filter(r, lambda c: c["text"] != ""), lambda c: c["text"]), " | ")
    lines = F.filter(F.transform(table["rows"], line), lambda x: x != "")
    return F.when(F.coalesce(table["found"], F.lit(False)), F.array_join(lines, " || ")).otherwise(tx.html_text(html))


def is_infobox(rows: Column) -> Column:
    """Of three rows or more, over 70 % of the first ten have two cells, the first of them a head."""
    first = F.slice(rows, 1, 10)
    fits = F.size(F.filter(first, lambda r: F.when(F.size(r) == 2, r[0]["head"]).otherwise(False)))
    return (F.size(rows) >= 3) & (fits / F.least(F.size(rows), F.lit(10)) > 0.7)


#: Column name: expression over `_rows` and what stands before it in the chain.
def structured(tables: DataFrame) -> DataFrame:
    """Adds kind, headers, rows, num_rows, num_cols to a frame with `table` (as parsed): data table, infobox or text."""
    texts = lambda r: F.transform(r, lambda c: c["text"])
    df = tables.withColumn(
        "_rows",
        F.slice(F.coalesce("table.rows", F.array().cast("array<array<struct<head:boolean,text:string>>>")), 1, 50),
    )
    df = df.withColumn("_box", is_infobox(F.col("_rows")))
    pairs = F.filter(F.filter("_rows", lambda r: F.size(r) >= 2), lambda r: r[0]["text"] != "")
    places = F.filter(
        F.sequence(F.lit(0), F.size("_rows") - 1),
        lambda i: (F.size(F.get("_rows", i)) > 0) & ((i == 0) | F.exists(F.get("_rows", i), lambda c: c["head"])),
    )
    df = df.withColumn("_head", F.when(F.size("_rows") > 0, F.try_element_at(places, F.lit(1))))
    df = df.withColumn("_names", F.filter(texts(F.slice(F.get("_rows", F.col("_head")), 1, 10)), lambda x: x != ""))
    body = F.filter(
        F.transform("_rows", lambda r, i: F.struct(i.alias("i"), texts(F.slice(r, 1, 10)).alias("c"))),
        lambda x: (F.coalesce(x["i"] != F.col("_head"), F.lit(True))) & F.exists(x["c"], lambda t: t != ""),
    )
    df = df.withColumn("_body", F.transform(body, lambda x: x["c"]))
    found = F.coalesce(F.col("table.found"), F.lit(False))
    none = F.array().cast("array<string>")
    names = F.when(
        F.col("_box"),
        F.slice(F.transform(pairs, lambda r: r[0]["text"]), 1, 10),
    ).otherwise(F.slice(F.coalesce("_names", none), 1, 10))
    values = F.when(F.col("_box"), F.slice(F.transform(pairs, lambda r: F.array(r[1]["text"])), 1, 10)).otherwise(F.slice("_body", 1, 50))
    widest = F.when(
        F.size("_body") > 0,
        F.array_max(F.transform("_body", lambda r: F.size(r))),
    ).otherwise(F.size(F.coalesce("_names", none)))
    return df.withColumns(
        {
            "kind": F.when(
                F.col("table.found").isNull(),
                "fallback",
            ).when(~found, "text").when(F.col("_box"), "infobox").otherwise("table"),
            "headers": F.when(found, names).otherwise(none),
            "rows": F.when(found, values).otherwise(F.array().cast("array<array<string>>")),
            "num_rows": F.when(found, F.when(F.col("_box"), F.size(pairs)).otherwise(F.size("_body"))).otherwise(0),
            "num_cols": F.when(found, F.when(F.col("_box"), 1).otherwise(widest)).otherwise(0),
        }
    ).drop("_rows", "_box", "_head", "_names", "_body")


def description(kind: Column, headers: Column, num_rows: Column, question: Column) -> Column:
    """A sentence about a table, with its question; at most 500 characters."""
    columns = F.when(
        F.size(headers) > 0,
        F.concat(F.lit(" with columns: "), F.array_join(F.slice(headers, 1, 5), ", ")),
    ).otherwise(F.lit(""))
    said = F.concat(
        F.lit("This table contains "),
        num_rows.cast("string"),
        F.lit(" rows"),
        columns,
        F.lit(". It relates to the question: "),
        F.substring(question, 1, 100),
    )
    plain = F.concat(F.lit("Table related to: "), question)
    return F.substring(F.when(kind.isin("table", "infobox"), said).otherwise(plain), 1, 500)


def processed(interactions: DataFrame, normalize_tags: bool = False) -> DataFrame:
    """Processed tables from (example_id, question, table_text, answers): identity, text, structure, description."""
    df = with_parsed(interactions, "table_text", "table", normalize_tags)
    df = structured(df.withColumn("linearized", linearized(F.col("table"), F.col("table_text"))))
    return df.select(
        tx.table_id(F.col("example_id"), F.col("question")).alias("table_id"),
        F.col("example_id").cast("string").alias("example_id"),
        "question",
        "answers",
        F.col("table_text").alias("html"),
        "linearized",
        "kind",
        "headers",
        "rows",
        "num_rows",
        "num_cols",
        description(F.col("kind"), F.col("headers"), F.col("num_rows"), F.col("question")).alias("description"),
        F.col("table.title").alias("title"),
        F.least(F.length("table_text"), F.lit(10000)).alias("estimated_size"),
        F.contains(F.lower("table_text"), F.lit("<table>")).alias("has_table_tag"),
    )


def normalized_cells(html: Column, normalize: Column | None = None) -> Column:
    """Headers and rows of the first table after a cell normaliser: by default lower case with punctuation set apart,
    as an uncased word-piece tokenizer gives it back for known words."""
    table = parsed(html)
    each = normalize or (lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"([^\p{L}\p{N}\s])", " $1 "), r"\s+", " ")))
    rows = F.transform(table["rows"], lambda r: F.transform(r, lambda c: each(c["text"])))
    return F.struct(
        F.coalesce(F.try_element_at(rows, F.lit(1)), F.array().cast("array<string>")).alias("headers"),
        F.slice(rows, 2, 1000).alias("rows"),
    )
