"""Token counts of whole texts, as a public tokenizer gives them.

Texts are encoded in batches inside Arrow functions that return lengths only. A
batch holds a bounded number of bytes. Every text, and so every long one, is split at
ASCII white space, which is a safe boundary where the tokenizer drops white space and
never joins across it; equal pieces of a batch are encoded once.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import batch_of, in_arrow, table
from .kernels import slices

#: Pieces whose counts a worker remembers; beyond it, it starts afresh.
REMEMBERED = 400_000
#: Longest piece to remember, in characters.
LONGEST = 64
MAX_TOKENS = 2048
VOCABULARY = "word_bpe_49k.json"


def splits_at_space(path: str) -> bool:
    """Whether white space parts tokens for this tokenizer file: it is replaced by a blank and no token may hold one."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = pre[0] if pre else {}
    pattern = (split.get("pattern") or {}).get("Regex", "")
    specials = [
        t for t in spec.get("added_tokens", []) if any(c.isspace() for c in t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"]
    ]
    normal = {n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])}
    drops = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True
    return drops and not specials and normal <= {"NFC", "Replace", "Lowercase"} and all(
        "\\s" not in part or part.startswith("[^") for part in pattern.split("|")
    )


class Counter:
    """Counts tokens of a batch of texts; holds one tokenizer and a bounded memory of pieces."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.pieces = splits_at_space(path)
        self.known: dict[str, int] = {}

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of each text; null counts as empty."""
        texts = texts.fill_null("")
        if not self.pieces:
            return np.array(self.lengths(texts.to_pylist()), np.int64)
        parts = pc.ascii_split_whitespace(texts)
        flat = parts.flatten().dictionary_encode()
        names = flat.dictionary.to_pylist()
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = [x for x in names if x not in known]
        fresh = dict(zip(new, self.lengths(new), strict=True))
        known.update((k, v) for k, v in fresh.items() if len(k) <= LONGEST)
        sizes = np.array([known[x] if x in known else fresh[x] for x in names], np.int64)
        total = np.concatenate(
            [[0], np.cumsum(sizes[flat.indices.to_numpy(zero_copy_only=False)])]
        ) if len(names) else np.zeros(1, np.int64)
        offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        return total[offsets[1:]] - total[offsets[:-1]]


_counters: dict[str, Counter] = {}


def token_counts(
    docs: DataFrame,
    path: str | Callable[[], str],
    *,
    limit: int = MAX_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each row of docs.

    path: a tokenizers JSON file, opened by each worker, or what gives a worker its path there. Null and empty texts have 0 bytes
    and 0 tokens; a null id, repeated ids and extra columns change nothing: one row for each row.
    """

    def per_batch(batch: pa.RecordBatch):
        here = path() if callable(path) else path
        if here not in _counters:
            _counters[here] = Counter(here)
        counter = _counters[here]
        ids, texts = batch.column(0), batch.column(1)
        for a, b, _, offsets in slices(texts):
            counts = counter.count(texts.slice(a, b - a))
            yield batch_of(doc_id=ids.slice(a, b - a), n_bytes=np.diff(offsets), n_tokens=counts, over_limit=counts > limit)

    kind = docs.schema[id_col].dataType.simpleString()
    return in_arrow(docs.select(id_col, text_col), per_batch, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def vocabulary() -> str:
    """Where the tokenizer file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary)
