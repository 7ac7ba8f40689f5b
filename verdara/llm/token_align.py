"""Alignment of the tokens of two public tokenizers over the same bytes.

Both tokenizers split blank + text, so the tokens of both cover the same byte range.  Inside a
batch each token start looks up the other side's token that covers it (an as-of join of the sorted
starts by binary search, in both directions); the union of both directions is every overlapping pair of tokens,
and the overlaps whose ranges end together are the links.  They cut the tokens into groups.

How often an id pair is linked is counted over all documents by one grouped aggregation.  Of two
tokens that end together one is a suffix of the other, so the number of different linked pairs is
bounded by the vocabularies and not by the corpus: a token has at most one partner per id spelled
like one of its suffixes (``possible_pairs``; 324,300 for the two default files).  That table is
collected and broadcast to a second, map-only pass.

Defined results: a text that is NULL or empty, or whose joined token bytes differ from blank + text
(U+2581 reads as a blank), has no tokens: zeros and an empty string.  Strings of special tokens are
ordinary text.  Repeated rows stay repeated and count each; empty table: no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from sentencepiece import SentencePieceProcessor

from verdara.llm.byte_bpe import groups_of
from verdara.llm.common import ship, with_fields
from verdara.llm.vocab import PIECES, byte_ids, file_bytes, once

BYTE_JSON = "byte_bpe_50k.json"
BLANK = "▁"
#: Characters aligned at once, in whole texts.
GROUP_CHARS = 200_000
FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps", "groups_sha256", "links"]
SCHEMA = ("n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, "
          "links array<{}>")


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable Latin-1 stands for itself,
    the other bytes in turn for the letters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Pair:
    """Both tokenizers in one worker."""

    def __init__(self, both: tuple[bytes, bytes]):
        letters = byte_letters()
        vocab = json.loads(both[0])["model"]["vocab"]
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items()}
        # the file's merges are in the order of the ids they make, so ids are ranks
        self.first = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                       mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.second = SentencePieceProcessor(model_proto=both[1])
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.second.is_byte(i)
                        else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.a_size = np.array([len(t) for t in self.a_bytes])
        self.b_size = np.array([len(t) for t in self.b_bytes])
        # decimal ids by place: inside a side of a group, at the end of the A side, of the B side
        a, b = ([b"%d" % i for i in range(len(t))] for t in (self.a_bytes, self.b_bytes))
        self.spelled = [x + end for ids, end in ((a, b","), (a, b"|"), (b, b","), (b, b";")) for x in ids]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides per text; none where the joined bytes of one differ from the text's."""
        a = [byte_ids(self.first, " " + t) if t else [] for t in texts]
        b = self.second.encode(texts, num_threads=1)
        n_a = np.array(list(map(len, a)))
        ends = np.concatenate([[0], np.cumsum(self.a_size[_flat(a)])])[np.concatenate([[0], np.cumsum(n_a)])]
        for k, (text, length) in enumerate(zip(texts, np.diff(ends).tolist())):
            want = (" " + text).encode()
            # tokens of the A side are bytes of the text in turn, so their length tells whether all are there
            if length != len(want) or b"".join(map(self.b_bytes.__getitem__, b[k])) != want:
                a[k], b[k] = [], []
        return a, b

    def side(self, own: list[list[int]], size: np.ndarray) -> dict[str, np.ndarray]:
        """Columns of the tokens: document, byte range within the batch, id, position."""
        ids = _flat(own)
        ends = np.cumsum(size[ids])
        doc = np.repeat(np.arange(len(own)), list(map(len, own)))
        return {"doc": doc, "start": ends - size[ids], "end": ends, "id": ids, "at": np.arange(len(ids))}

    def align(self, texts: list[str]) -> pd.DataFrame:
        own_a, own_b = self.encode(texts)
        a, b = self.side(own_a, self.a_size), self.side(own_b, self.b_size)
        both = overlaps(a, b)
        i, j = both["a"].to_numpy(), both["b"].to_numpy()
        together = a["end"][i] == b["end"][j]
        n_overlaps = np.bincount(a["doc"][i], minlength=len(texts))
        i, j = np.sort(i[together]), np.sort(j[together])  # in turn: a token has one end
        n_a, n_b = (np.array(list(map(len, own))) for own in (own_a, own_b))
        n_links = np.bincount(a["doc"][i], minlength=len(texts))
        code, place = self._in_turn(a["id"], b["id"], i, j)
        ordered = np.empty(len(code), np.int64)
        ordered[place] = code
        link = a["id"][i] * len(self.b_bytes) + b["id"][j]
        digests, links, at, link_at = [], [], 0, 0
        for n, k in zip((n_a + n_b).tolist(), n_links.tolist()):
            text = b"".join(map(self.spelled.__getitem__, ordered[at:at + n].tolist()))
            digests.append(hashlib.sha256(text[:-1]).hexdigest() if n else "")
            links.append(link[link_at:link_at + k])
            at, link_at = at + n, link_at + k
        return pd.DataFrame({"n_a": n_a, "n_b": n_b, "n_groups": n_links, "n_links": n_links,
                             "n_overlaps": n_overlaps, "groups_sha256": digests, "links": links})

    def _in_turn(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray):
        """(spelling, place) of all tokens: each group's A tokens, then its B tokens."""
        n_a, n_b = len(self.a_bytes), len(self.b_bytes)
        size_a, size_b = np.diff(i, prepend=-1), np.diff(j, prepend=-1)
        before_b, with_a = np.cumsum(size_b) - size_b, np.cumsum(size_a)
        place = np.concatenate([np.arange(len(a)) + np.repeat(before_b, size_a),
                                np.arange(len(b)) + np.repeat(with_a, size_b)])
        last_a, last_b = np.zeros(len(a), int), np.zeros(len(b), int)
        last_a[i], last_b[j] = n_a, n_b
        return np.concatenate([a + last_a, b + last_b + 2 * n_a]), place


def _flat(own: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(own), np.int64, sum(map(len, own)))


def overlaps(a, b) -> pd.DataFrame:
    """(a, b): positions of all pairs of tokens of a document whose byte ranges overlap.

    Both sides hold (doc, start, at) in the order of start; starts grow from document to document.
    Two ranges overlap if and only if one of them covers the other's start.
    """
    a, b = ({c: np.asarray(x[c]) for c in ("doc", "start", "at")} for x in (a, b))
    in_b, own_a = _covering(b, a)
    in_a, own_b = _covering(a, b)
    new = a["start"][in_a] != b["start"][own_b]  # equal starts are found from both sides
    return pd.DataFrame({"a": np.concatenate([a["at"][own_a], a["at"][in_a[new]]]),
                         "b": np.concatenate([b["at"][in_b], b["at"][own_b[new]]])})


def _covering(side: dict[str, np.ndarray], other: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``side`` that cover the starts of ``other``'s rows, and these rows."""
    at = np.searchsorted(side["start"], other["start"], side="right") - 1
    own = np.flatnonzero(at >= 0)
    own = own[side["doc"][at[own]] == other["doc"][own]]
    return at[own], own


def possible_pairs(a: list[bytes], b: list[bytes]) -> int:
    """Number of id pairs of two vocabularies that can end together: one is the other's suffix."""
    n_a, n_b = Counter(a), Counter(b)
    longer_a = sum(n_b[t[k:]] for t in a for k in range(len(t)))
    return longer_a + sum(n_a[t[k:]] for t in b for k in range(1, len(t)))


def align(docs: DataFrame, text: str = "text", first_path: str | None = None,
          second_path: str | None = None) -> DataFrame:
    """Add the counts, the digest of the groups, and ``links``: A id · (size of B) + B id of each."""
    ship(docs.sparkSession)
    first = file_bytes(first_path, BYTE_JSON)
    data = docs.sparkSession.sparkContext.broadcast((first, file_bytes(second_path, PIECES)))
    pairs = (max(json.loads(first)["model"]["vocab"].values()) + 1) * vocabulary_size(second_path)

    @pandas_udf(SCHEMA.format("int" if pairs < 1 << 31 else "long"))
    def fn(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pair = once(Pair, data)
        for texts in batches:
            # rows leave by groups, so the links of few texts are held at once
            yield from map(pair.align, groups_of([t or "" for t in texts], GROUP_CHARS))

    return with_fields(docs, fn(F.col(text)), FIELDS)


def count_links(aligned: DataFrame, second_size: int) -> DataFrame:
    """(pair, n, best): how often each id pair is linked, and whether no other A id is linked with
    the pair's B id more often."""
    counts = (aligned.select(F.explode("links").alias("pair")).groupBy("pair")
              .agg(F.count(F.lit(1)).alias("n")))
    of_b = Window.partitionBy(F.col("pair") % second_size)
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(of_b)).alias("best"))


def judge(aligned: DataFrame, counts: pd.DataFrame) -> DataFrame:
    """n_best and count_sum in place of each row's links, from the collected rows of ``count_links``."""
    counts = counts.sort_values("pair")
    table = aligned.sparkSession.sparkContext.broadcast(tuple(
        counts[c].to_numpy(t) for c, t in (("pair", np.int64), ("n", np.int64), ("best", np.int64))))

    made = ["n_best", "count_sum"]
    kept = [c for c in aligned.columns if c not in [*made, "links"]]
    rows = aligned.select(*[F.col(f"`{c}`") for c in [*kept, "links"]])
    schema = T.StructType([f for f in rows.schema.fields if f.name != "links"]
                          + [T.StructField(c, T.LongType()) for c in made])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = table.value
        parts = (batch.slice(i, 1000) for batch in batches for i in range(0, batch.num_rows, 1000))
        for batch in parts:
            links = batch.column(len(kept))
            at = np.searchsorted(pair, links.flatten().to_numpy())
            edges = links.offsets.to_numpy() - links.offsets[0].as_py()
            sums = [np.concatenate([[0], np.cumsum(v[at])])[edges] for v in (best, n)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *[pa.array(np.diff(s), pa.int64()) for s in sums]],
                names=[*kept, *made])

    return rows.mapInArrow(fn, schema)


def vocabulary_size(second_path: str | None = None) -> int:
    return SentencePieceProcessor(model_proto=file_bytes(second_path, PIECES)).get_piece_size()
