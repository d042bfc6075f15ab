"""Token counts with a shortcut for whole tokens.

Before any text is read, each vocabulary string that can stand as one pre-token is put through all merges: those that
come out as one token are the proven shortcuts. Texts are cut into pre-tokens; each that is a shortcut counts one
directly, and only the others are merged (and remembered, within a bound).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import KEPT, ODD, QUICK, REMEMBERED, SPACE, Model, byte_letters, live, together

# Fixed value of the byte-level format: its pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+".replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")


class Counter:
    """Tokens of pre-tokens: ``known`` starts with the proven shortcuts of the model, each 1, and takes what has been merged."""

    def __init__(self, model: Model):
        self.model, self.special = model, model.splitter()
        self.one = dict.fromkeys([*model.proven, *model.special], 1)
        self.find = regex.compile(PATTERN).findall
        self.quick = re.compile(rf" ?[{QUICK}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s0-9{QUICK}]+|\s+(?!\S)|\s+").findall
        self.known = dict(self.one)

    def pieces(self, text: str) -> list[str]:
        special = self.special
        if special is not None and "<|" in text and special.search(text):
            return list(chain.from_iterable([part] if part in self.model.special else self.plain(part) for part in special.split(text)))
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        return self.find(text) if ODD(text) else self.quick(text)

    def count_all(self, texts: list[str]) -> list[int]:
        cut = [self.pieces(t) for t in texts]
        rest = set(chain.from_iterable(cut)).difference(self.known)
        if len(self.known) + len(rest) > REMEMBERED:
            self.known = dict(self.one)
            rest = set(chain.from_iterable(cut)).difference(self.known)
        rest = list(rest)
        _, count = self.model.merge_many([p.encode() for p in rest])
        self.known.update(zip(rest, count.tolist(), strict=True))
        look = self.known.__getitem__
        n = [sum(map(look, c)) for c in cut]
        for p in rest:
            if len(p) > KEPT:
                del self.known[p]
        return n


def shortcuts(model: Model) -> list[str]:
    """The vocabulary strings that are whole pre-tokens and, merged alone, one token."""
    back = {c: b for b, c in enumerate(byte_letters())}
    find, out = regex.compile(PATTERN), []
    for i, token in enumerate(model.tokens):
        if not token or token in model.special:
            continue
        raw = bytes(back[c] for c in token)
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue
        if find.fullmatch(text) and model.merge(raw) == [i]:
            out.append(text)
    return out


def _count_rows(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = live("counter", Counter, shipped)
        for batch in batches:
            n = list(chain.from_iterable(map(counter.count_all, together(batch.column(1)))))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs`` (doc_id, text) with the byte-level file at ``path``.

    A null text is empty: no bytes, no tokens. Special strings inside a text count as their one token. Texts are read whole
    however long. Rows are kept as they are, repeated or not; an empty table gives none. The driver reads the file; what is sent to the executors is bounded by it.
    """
    model = Model(path)
    model.proven = shortcuts(model)  # proven once, before any text is read
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(_count_rows(shipped), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
