"""Scores of texts under a hierarchical Pitman-Yor model.

Tokens are the words of a text (A-Z in lower case) and one end.  Every preceding word has its own
context restaurant, and so has the begin of a text.  All context restaurants share the root
restaurant as their parent, whose base measure is uniform over the known words and one unknown
word.  Customers of a context are the training tokens, the tables of contexts send one customer
each to the root.  What is learned of contexts so grows with the input; no context is pooled.

Seating is sampled by Gibbs, by numbers of tables: the tables of a cell (context, word) are drawn from
their distribution given the customers of the cell, the other tables of its restaurant and the root
probability of the word (generalised Stirling numbers); cells with more than EXACT customers are
seated customer by customer, long runs of them as binomial blocks.  The cells of a restaurant are
drawn together from the totals of the sweep before.  A cell of one customer has one table, so sweeps
only pass on cells of several.  After BURN_IN sweeps the root stays, and the predictive
probabilities of SAMPLES seatings are averaged.  Discounts are those of absolute discounting, one for
contexts and one for the root.

Layout: texts are split into words once and kept as slices of word numbers (``coded_slices``).  The
cells of a slice, one of each pair of words, are dealt to parts by the hash of their context, so a
restaurant is whole in one part; those of words with a share of 1/SHARED are split by word, and their
totals (at most 8/7 SHARED numbers) are brought together after each sweep.  A part answers each
slice with the scores of its cells in the order in which they came, and the slice adds them up by
text, so cells are dealt once and neither texts nor tokens leave their slice.  Pairs of two words
with a share of 1/FREQUENT are counted in one bounded table and never shuffled by pair, so no part
holds a hot pair.  The root's customers are rows (word, number), summed by word and joined back to
the parts that ask for the word.  Words are told apart by 63-bit hashes.

Defined results: NULL or empty text: the end token alone.  Repeated rows count each in training
and get equal scores.  NULL key: crc32 of the
empty text decides.  Empty table: no rows.  No training tokens: every token has the base
probability.  Columns beside key and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import count
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest
from zstandard import ZstdCompressor, ZstdDecompressor

from verdara.llm.common import ship
from verdara.sources.scratch import brief_shuffles, bucketed, emptied, scratch_dir, stored

#: Shares from which on a word has a row in the table of word pairs (at most FREQUENT words) and from
#: which on its restaurant is split over parts (at most 8/7 SHARED).  The model depends on neither.
FREQUENT, SHARED = 1024, 8192
BURN_IN, SAMPLES = 2, 4
STRENGTH = 1.0
#: Customers of a cell up to which its tables are drawn from the exact conditional distribution.
EXACT = 128
#: Chances of numbers of tables, and words of the root, that are held at once.
CELLS, WORDS = 500_000, 200_000
BATCH_BYTES = 6_000_000
PART_CHARS = 10_000_000
_END = b" end"  # words hold no blanks
_SEED = 20
_RARE = np.uint64(1 << 63)  # set in the codes of words without a number


def _packed(numbers: np.ndarray, width: int = 4) -> bytes:
    """Numbers of so many bytes, by the places of the bytes, compressed."""
    planes = np.ascontiguousarray(numbers, f"<u{width}").view("u1").reshape(-1, width).T
    return ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes, width: int = 4) -> np.ndarray:
    planes = np.frombuffer(ZstdDecompressor().decompress(data), "u1").reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


def _packed_codes(codes: np.ndarray) -> bytes:
    """Codes by their differences, which are small where they ascend."""
    return _packed(np.diff(codes, prepend=np.uint64(0)), 8)


def _unpacked_codes(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, 8).view(np.uint64))


def _packed_floats(values: np.ndarray) -> bytes:
    """Rounded to 36 bits after the point, which leaves 6 bytes each."""
    return _packed((np.ascontiguousarray(values, "<f8").view(np.uint64) + np.uint64(1 << 15)) >> np.uint64(16), 8)


def _unpacked_floats(data: bytes) -> np.ndarray:
    return (_unpacked(data, 8).view(np.uint64) << np.uint64(16)).view(float)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut into slices of about BATCH_BYTES bytes of text, without copies."""
    size = pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size.astype(np.int64)) // BATCH_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
    for at, end in zip(cuts, cuts[1:]):
        if end > at:
            yield batch.slice(at, end - at)


def _as_rows(fn, kinds: dict[str, pa.DataType]):
    """For ``mapInArrow``: ``fn`` gets a row as a dict, binary columns as buffers, and yields rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                made = list(fn(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m[i] for m in made], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    return run


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {n: c[i].as_buffer() if c.type == pa.binary() else c[i].as_py()
               for n, c in zip(batch.schema.names, batch.columns)}


# --- slices ---

_SLICE = {"slice": pa.int64(), "train": pa.binary(), "sizes": pa.binary(), "hashes": pa.binary(), "at": pa.binary(),
          "own": pa.list_(pa.binary()), "own_n": pa.list_(pa.int64()), "tokens": pa.int64(), "chars": pa.int64()}
_SLICE_DDL = ("slice long, train binary, sizes binary, hashes binary, at binary, own array<binary>, "
              "own_n array<long>, tokens long, chars long")


def _coded(texts: pa.Array, train: np.ndarray) -> tuple:
    """Words of texts by their order of appearance, then the end; hashes of the words; words with a
    share of 1/(8 SHARED) of the training tokens and their counts; numbers of training tokens and
    of characters."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = split.flatten()
    kept = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    past = np.concatenate([[0], np.cumsum(kept)])
    size = np.diff(past[split.offsets.to_numpy() - split.offsets[0].as_py()]) + 1
    coded = words.filter(pa.array(kept)).dictionary_encode()
    distinct = [*coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False), _END]
    end = np.zeros(size.sum(), bool)
    end[np.cumsum(size) - 1] = True
    at = np.full(len(end), len(distinct) - 1)
    at[~end] = coded.indices.to_numpy()
    hashes = np.fromiter(map(xxh64_intdigest, distinct), np.uint64, len(distinct)) | _RARE
    n = np.bincount(at[np.repeat(train, size)], minlength=len(distinct))
    own = np.flatnonzero((n * (8 * SHARED) >= n.sum()) & (n > 0))
    return (train.astype("u1").tobytes(), _packed(size), hashes.tobytes(), _packed(at),
            [distinct[i] for i in own.tolist()], n[own].tolist(), int(n.sum()),
            pc.sum(pc.utf8_length(texts)).as_py() or 0)


def coded_slices(rows: DataFrame) -> DataFrame:
    """Slices of the rows (_key, _text, _train): numbers of the words of each text in place of the texts.
    They are bucketed, so that answers of the parts come to them without a shuffle of the slices."""
    kind = dict(rows.dtypes)["_key"]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for part in _slices(batch):
                made = _coded(part.column("_text"), part.column("_train").to_numpy(zero_copy_only=False))
                keys = part.column("_key")
                keys = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
                yield pa.RecordBatch.from_arrays(
                    [keys, *[pa.array([x], t) for x, t in zip((next(number), *made), _SLICE.values())]],
                    names=["keys", *_SLICE])

    return bucketed(rows.mapInArrow(fn, f"keys array<{kind}>, {_SLICE_DDL}"), "slice",
                    int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def numbered_words(slices: DataFrame) -> tuple[list[bytes], int, int, int]:
    """Words that may have a share of 1/SHARED of the training tokens, most frequent first; how many
    of them are frequent; numbers of training tokens and of characters.

    A word's count in slices where it is rarer than 1/(8 SHARED) is missing from its sum; that is
    less than an eighth of the share asked for.  So at most 8/7 SHARED words are kept.
    """
    total, chars = (x or 0 for x in slices.agg(F.sum("tokens"), F.sum("chars")).first())
    found = (slices.select(F.explode(F.arrays_zip("own", "own_n")).alias("x"))
             .groupBy(F.col("x.own").alias("word")).agg(F.sum("x.own_n").alias("n"))
             .where(F.col("n") * (8 * SHARED) >= 7 * total).collect())
    found = sorted(found, key=lambda r: (-r["n"], bytes(r["word"])))
    return [bytes(r["word"]) for r in found], sum(r["n"] * FREQUENT >= total for r in found), total, chars


class Numbers(NamedTuple):
    """Hashes of the numbered words in order and their numbers; how many words are frequent."""

    hashes: np.ndarray
    numbers: np.ndarray
    frequent: int

    @classmethod
    def of(cls, words: list[bytes], frequent: int) -> Numbers:
        hashes = np.array([xxh64_intdigest(w) for w in words], np.uint64) | _RARE
        order = np.argsort(hashes)
        return cls(hashes[order], order.astype(np.uint64), frequent)

    @property
    def begin(self) -> int:
        return len(self.hashes)

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """The code of a word is its number or else its hash with the highest bit set."""
        if not self.begin:
            return hashes
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.begin - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], hashes)


class Tokens:
    """Tokens of a slice: ``codes`` of its words and the begin in order; places of the words of the
    tokens and of those before them among ``codes``; which are frequent pairs, in the table."""

    def __init__(self, row: dict, numbers: Numbers):
        begin = np.uint64(numbers.begin)
        code = numbers.codes(np.frombuffer(row["hashes"], "<u8"))
        self.codes, place = np.unique(np.append(code, begin), return_inverse=True)
        self.size = _unpacked(row["sizes"])
        self.train = np.repeat(np.frombuffer(row["train"], "u1"), self.size) > 0
        self.word = place[_unpacked(row["at"])]
        self.context = np.roll(self.word, 1)
        self.context[np.cumsum(self.size) - self.size] = place[-1]
        frequent = self.codes < numbers.frequent
        self.in_table = frequent[self.word] & (frequent | (self.codes == begin))[self.context]

    def table_cells(self, own: np.ndarray, frequent: int) -> np.ndarray:
        """Cells of the table, by (word, context), of tokens in it; begin comes last."""
        column = np.minimum(self.codes, np.uint64(frequent)).astype(int)
        return column[self.word[own]] * (frequent + 1) + column[self.context[own]]

    def cells(self, parts: int) -> tuple[np.ndarray, ...]:
        """Places of context and word of the cells outside the table, by (part, context, word); their
        parts; the cell of each token outside."""
        rest = ~self.in_table
        cell, of = np.unique(self.context[rest] * len(self.codes) + self.word[rest], return_inverse=True)
        context, word = np.divmod(cell, len(self.codes))
        part = _part_of(self.codes[context], self.codes[word], parts)
        order = np.argsort(part, kind="stable")
        rank = np.empty(len(order), int)
        rank[order] = np.arange(len(order))
        return context[order], word[order], part[order], rank[of]


_WORK = ["slice", "train", "sizes", "hashes", "at"]


def frequent_table(slices: DataFrame, numbers) -> np.ndarray:
    """Training counts of frequent pairs; FREQUENT alone bounds their number."""
    frequent = numbers.value.frequent

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(frequent * (frequent + 1), np.int64)
        for batch in batches:
            for row in _each(batch):
                t = Tokens(row, numbers.value)
                table += np.bincount(t.table_cells(t.in_table & t.train, frequent), minlength=len(table))
        cell = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(table[cell])], names=["cell", "n"])

    found = (slices.select(*_WORK).mapInArrow(fn, "cell long, n long")
             .groupBy("cell").agg(F.sum("n").alias("n")).toPandas())
    table = np.zeros(frequent * (frequent + 1), np.int64)
    table[found["cell"]] = found["n"]
    return table.reshape(frequent, frequent + 1)


def _mixed(code: np.ndarray) -> np.ndarray:
    """Bits spread over the whole number."""
    for _ in range(2):
        code = (code ^ code >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return code


def _part_of(context: np.ndarray, word: np.ndarray, parts: int) -> np.ndarray:
    """By the context; split restaurants by the pair."""
    mixed = np.where(context >= _RARE, context, context * np.uint64(0x9E3779B97F4A7C15) + word)
    return ((_mixed(mixed) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(int)


def _firsts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Positions where a new combination begins."""
    if not len(sorted_columns[0]):
        return np.zeros(0, int)
    new = np.zeros(len(sorted_columns[0]), bool)
    new[0] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


_DEALT = {"part": pa.int64(), "slice": pa.int64(), "rare": pa.binary(), "numbers": pa.binary()}


def _deal(numbers, parts: int):
    """One row per part: the slice's cells by context, with their training tokens.  A cell names its
    word by the place among the row's words."""
    def fn(row: dict) -> Iterator[tuple]:
        t = Tokens(row, numbers.value)
        context, word, part, of = t.cells(parts)
        size = np.bincount(of, t.train[~t.in_table], len(part)).astype(np.int64)
        begin = _firsts(part)
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(part)]):
            first = _firsts(context[a:b])
            words, at = np.unique(word[a:b], return_inverse=True)
            contexts, words = t.codes[context[a:b][first]], t.codes[words]
            low, low_words = contexts[contexts < _RARE], words[words < _RARE]
            yield (int(part[a]), row["slice"],
                   _packed_codes(np.concatenate([contexts[len(low):], words[len(low_words):]])),
                   _packed(np.concatenate([x.astype(np.int64) for x in (
                       [np.array([len(low), len(contexts), len(low_words)])]
                       + [np.diff(x, prepend=np.uint64(0)) for x in (low, low_words)]
                       + [np.diff(np.append(first, b - a)), at, size[a:b]])])))

    return _as_rows(fn, _DEALT)


def _dealt_cells(rare: bytes, numbers: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, word and training tokens of the cells of a row of ``_deal``."""
    low, n, low_words, *_ = x = _unpacked(numbers)
    high = _unpacked_codes(rare)
    x = x[3:]
    contexts = np.concatenate([np.cumsum(x[:low]).astype(np.uint64), high[:n - low]])
    words = np.concatenate([np.cumsum(x[low:low + low_words]).astype(np.uint64), high[n - low:]])
    x = x[low + low_words:]
    at, size = x[n:].reshape(2, -1)
    return np.repeat(contexts, x[:n]), words[at], size


# --- seating ---

@lru_cache(maxsize=4)
def _stirling(discount: float) -> np.ndarray:
    """log of the weight of seatings of c customers at t tables, without the tables' own weights."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    tables = np.arange(1, EXACT + 1)
    for c in range(1, EXACT + 1):
        join = np.full(EXACT, -np.inf)
        join[:c - 1] = np.log(c - 1 - discount * tables[:c - 1]) + out[c - 1, 1:c]
        out[c, 1:] = np.logaddexp(join, out[c - 1, :-1])
    return out


def seat(customers: np.ndarray, new_weight: np.ndarray, discount: float,
         random: np.random.Generator) -> np.ndarray:
    """Tables of each group of customers of one word in one restaurant, customer by customer.

    ``new_weight``: weight of a new table, (strength + discount * tables) * parent probability.
    The first customer opens a table; a later one joins with weight seated - discount * tables.
    """
    tables = np.minimum(customers, 1)
    at = np.flatnonzero(customers > 1)
    seated = np.ones(len(at), np.int64)
    open_ = np.ones(len(at), np.int64)
    total, weight = customers[at], new_weight[at]
    going = np.arange(len(at))
    while len(going):
        n, k = seated[going], open_[going]
        block = np.minimum(np.maximum(1, n // 8), total[going] - n)
        chance = weight[going] / (weight[going] + n - discount * k)
        open_[going] = k + random.binomial(block, np.minimum(chance, 1))
        seated[going] = n + block
        going = going[seated[going] < total[going]]
    tables[at] = open_
    return tables


def seat_one(customers: int, new_weight: float, discount: float, random: np.random.Generator) -> int:
    """``seat`` for a single group, with the same draws; much faster than arrays of one number."""
    seated = tables = min(customers, 1)
    while seated < customers:
        block = min(max(1, seated // 8), customers - seated)
        tables += int(random.binomial(block, min(new_weight / (new_weight + seated - discount * tables), 1.0)))
        seated += block
    return tables


def draw_tables(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float,
                random: np.random.Generator, uniform: np.ndarray | None = None) -> np.ndarray:
    """Tables of each cell given the ``others`` of its restaurant and the parent probability."""
    uniform = random.random(len(customers)) if uniform is None else uniform
    others = np.maximum(others, 0)  # totals of split restaurants are those of the sweep before
    tables = np.minimum(customers, 1).astype(np.int64)
    weight = _stirling(discount)
    several = np.flatnonzero((customers > 1) & (customers <= EXACT))
    several = several[np.argsort(customers[several], kind="stable")]
    first = _firsts(customers[several])
    blocks = [several[i:min(i + CELLS // customers[several[a]], b)]
              for a, b in zip(first.tolist(), [*first[1:].tolist(), len(several)])
              for i in range(a, b, CELLS // customers[several[a]])]
    for at in blocks:
        c = int(customers[at[0]])
        t = np.arange(c)
        opened = np.log(STRENGTH + discount * (others[at, None] + t)) + np.log(parent[at, None])
        logs = weight[c, 1:c + 1] + np.cumsum(opened, axis=1)
        sums = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
        tables[at] = 1 + (uniform[at, None] * sums[:, -1:] > sums).sum(axis=1)
    at = np.flatnonzero(customers > EXACT)
    tables[at] = seat(customers[at], (STRENGTH + discount * others[at]) * parent[at], discount, random)
    return tables


class Shared(NamedTuple):
    """What parts have in common: discount of contexts; tables and customers of the restaurants that
    are split, by number (the begin last)."""

    discount: float
    tables: np.ndarray
    customers: np.ndarray


def _discount(ones: float, twos: float) -> float:
    """As for absolute discounting, inside its open range."""
    return float(min(0.95, max(0.05, ones / (ones + 2 * twos)))) if ones + twos else 0.5


def _totals(codes: np.ndarray, own: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Totals of restaurants: of those that are split from ``shared``, else the part's own."""
    if not len(shared):
        return own
    split = codes < _RARE
    return np.where(split, shared[np.where(split, codes, 0).astype(int)], own)


# --- parts ---

#: Of all cells: words, word_at, n, houses, runs; of the slices' cells: slices, sizes, steps.
_HELD = ("slices", "words", "houses", "tokens", "alone", "word_at", "n", "runs", "sizes", "steps")
#: Of the cells of several customers, for the sweeps.
_CELLS = ("codes", "contexts", "code_at", "context", "count", "tables", "singles", "customers")
_CODES = ("codes", "contexts", "words", "houses")
_PACKED = tuple(c for c in _HELD[1:] + _CELLS if c not in _CODES)
_HELD_DDL = "part long, ones long, twos long, " + ", ".join(f"{c} binary" for c in _HELD)


def _packed_columns(values: dict[str, np.ndarray]) -> dict[str, bytes]:
    return {c: _packed_codes(x) if c in _CODES else _packed(x.astype("<u4")) for c, x in values.items()}


def _gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One row per part: its cells and their words with training tokens and cells of one customer;
    for each slice the steps between its cells."""
    made = [_dealt_cells(a, b) for a, b in zip(rows["rare"], rows["numbers"])]
    sizes = np.array([len(m[0]) for m in made])
    context, word, n = (np.concatenate(c) for c in zip(*made))
    del made
    order = np.lexsort((word, context))
    context, word, n = context[order], word[order], n[order]
    cell = _firsts(context, word)
    of = np.empty(len(order), np.int64)
    of[order] = np.repeat(np.arange(len(cell)), np.diff(np.append(cell, len(order))))
    steps = np.diff(of, prepend=0)  # a slice's cells are in order, too
    steps[np.cumsum(sizes) - sizes] = of[np.cumsum(sizes) - sizes]
    context, word, n = context[cell], word[cell], np.add.reduceat(n, cell)
    words, word_at = np.unique(word, return_inverse=True)
    first = _firsts(context)
    packed = {"words": words, "houses": context[first], "tokens": np.bincount(word_at, n, len(words)),
              "alone": np.bincount(word_at, n == 1, len(words)), "word_at": word_at, "n": n,
              "runs": np.diff(np.append(first, len(context))), "sizes": sizes, "steps": steps}
    return pd.DataFrame({"part": [int(key[0])], "ones": [int((n == 1).sum())], "twos": [int((n == 2).sum())],
                         "slices": [rows["slice"].to_numpy("<i8").tobytes()]}
                        | {c: [x] for c, x in _packed_columns(packed).items()})


def _several(row: dict) -> Iterator[tuple]:
    """Of a part, the cells of several customers; the restaurants that have such cells or are split."""
    n, houses = _view(row, "n"), _view(row, "houses")
    house = np.repeat(np.arange(len(houses)), _view(row, "runs"))
    several = n > 1
    keep = (houses < _RARE) | (np.bincount(house, several, len(houses)) > 0)
    place = np.cumsum(keep) - 1
    codes, code_at = np.unique(_view(row, "words")[_view(row, "word_at")[several]], return_inverse=True)
    yield (row["part"], *_packed_columns(dict(zip(_CELLS, (
        codes, houses[keep], code_at, place[house[several]], n[several], np.ones(several.sum()),
        np.bincount(house, n == 1, len(houses))[keep], np.bincount(house, n, len(houses))[keep])))).values())


def _view(row, name: str) -> np.ndarray:
    if name in _PACKED:
        return _unpacked(row[name])
    return _unpacked_codes(row[name]) if name in _CODES else np.frombuffer(row[name], "<i8")


def _unfold(fn, names: tuple[str, ...]):
    """For ``mapInArrow``: ``fn`` makes columns of longs of each part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in fn(row)], names=list(names))

    return run


def _rows(held: DataFrame, fn, *names: str) -> DataFrame:
    return held.mapInArrow(_unfold(fn, names), ", ".join(f"{n} long" for n in names))


def _word_counts(row) -> tuple[np.ndarray, ...]:
    tokens = _view(row, "tokens")
    known = tokens > 0
    return _view(row, "words")[known], tokens[known], _view(row, "alone")[known]


def _word_tables(row) -> tuple[np.ndarray, ...]:
    codes = _view(row, "codes")
    return codes, np.zeros(len(codes), np.int64), np.bincount(
        _view(row, "code_at"), _view(row, "tables"), len(codes)).astype(np.int64)


def _house_tables(row) -> np.ndarray:
    return _view(row, "singles") + np.bincount(
        _view(row, "context"), _view(row, "tables"), len(_view(row, "contexts"))).astype(np.int64)


def _split_totals(begin: int):
    """Tables and customers of the split restaurants in all parts of a task together: nearly every
    part has each of them."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, customers = np.zeros((2, begin + 1), np.int64)
        for batch in batches:
            for row in _each(batch):
                codes = _view(row, "contexts")
                split = codes < _RARE
                own = codes[split].astype(int)
                tables[own] += _house_tables(row)[split]
                customers[own] += _view(row, "customers")[split]
        code = np.flatnonzero(customers)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (code, tables[code], customers[code])],
                                         names=["code", "tables", "customers"])

    return fn


def _parents(codes: np.ndarray, roots: pd.DataFrame, column: str, missing: float) -> np.ndarray:
    """The column's value for each code."""
    known = roots["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    known, values = known[order], roots[column].to_numpy(float)[order]
    at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
    return np.where(known[at] == codes, values[at], missing) if len(known) else np.full(len(codes), missing)


def _root_of(codes: np.ndarray, roots: int) -> np.ndarray:
    """Part of the root that seats a word; grows with the code."""
    return ((codes >> np.uint64(32)) * np.uint64(roots) >> np.uint64(32)).astype(int)


def _answer(unknown: float):
    """Root probabilities and training tokens of the words asked for by each part."""
    def fn(key: tuple, asked: pd.DataFrame, roots: pd.DataFrame) -> pd.DataFrame:
        words = [_unpacked_codes(w) for w in asked["words"]]
        if not words:
            return pd.DataFrame({"part": [], "root": [], "p": [], "n": []})
        ends, words = np.cumsum(list(map(len, words)))[:-1], np.concatenate(words)
        p, n = _parents(words, roots, "p", unknown), _parents(words, roots, "n", 0.0).astype(np.int64)
        return pd.DataFrame({"part": asked["part"], "root": int(key[0]),
                             "p": [_packed(x.view(np.uint64), 8) for x in np.split(p, ends)],
                             "n": [_packed(x, 8) for x in np.split(n, ends)]})

    return fn


def ask(held: DataFrame, name: str, root: Root, parts: int) -> DataFrame:
    """What the root knows of the codes of each part, packed: (part, root, p, n) in the order of root."""
    roots = 2 * parts  # the highest bit is set in nearly all codes

    def fn(row: dict) -> Iterator[tuple]:
        codes = _view(row, name)
        of = _root_of(codes, roots)
        for own, at in zip(np.split(codes, _firsts(of)[1:]), of[_firsts(of)].tolist()):
            yield at, row["part"], _packed_codes(own)

    asked = held.select("part", name).mapInArrow(
        _as_rows(fn, {"root": pa.int64(), "part": pa.int64(), "words": pa.binary()}), "root long, part long, words binary")
    at = F.shiftrightunsigned(F.shiftrightunsigned("word", 32) * F.lit(roots).cast("long"), 32)
    return (asked.groupBy("root").cogroup(root.words.withColumn("root", at).groupBy("root"))
            .applyInPandas(_answer(root.unknown), "part long, root long, p binary, n binary"))


def _answered(answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """p and n of a part's codes."""
    answers = answers.sort_values("root")
    p, n = (np.concatenate([np.zeros(0, np.int64), *[_unpacked(x, 8) for x in answers[c]]]) for c in ("p", "n"))
    return p.view(float), n


def _sweep(shared: Shared, number: int):
    """Draws the tables of a part's cells of several customers anew."""
    def fn(key: tuple, held: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(held):
            return held
        row = held.iloc[0]
        house, tables = _view(row, "context"), _view(row, "tables")
        totals = _totals(_view(row, "contexts"), _house_tables(row), shared.tables)
        drawn = draw_tables(_view(row, "count"), totals[house] - tables,
                            _answered(answers)[0][_view(row, "code_at")], shared.discount,
                            np.random.default_rng([_SEED, number, int(key[0])]))
        return held.assign(tables=[_packed(drawn)])

    return fn


_ANSWER = "slice long, part long, score binary, n binary"


def _score_part(shared: Shared):
    """One row per slice: log10 probabilities of its cells and training tokens of their words."""
    def fn(key: tuple, held: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out: dict = {c: [] for c in ("slice", "part", "score", "n")}
        for _, row in held.iterrows():
            at = _view(row, "word_at")
            p, n = (x[at] for x in _answered(answers))
            context = np.repeat(_view(row, "houses"), _view(row, "runs"))
            log_p = np.log10(predictive(context, _view(row, "n"), p, shared, int(key[0])))
            ends = np.cumsum(_view(row, "sizes"))
            for number, steps in zip(_view(row, "slices").tolist(), np.split(_view(row, "steps"), ends[:-1])):
                of = np.cumsum(steps)
                out["slice"].append(number)
                out["part"].append(int(key[0]))
                out["score"].append(_packed_floats(log_p[of]))
                out["n"].append(_packed(n[of], 8))
        return pd.DataFrame(out)

    return fn


def predictive(context: np.ndarray, count: np.ndarray, parent: np.ndarray, shared: Shared,
               part: int) -> np.ndarray:
    """Probability of each cell's word in its context, averaged over SAMPLES seatings."""
    houses, house = np.unique(context, return_inverse=True)
    customers = _totals(houses, np.bincount(house, count, len(houses)), shared.customers)[house]
    tables = np.minimum(count, 1)
    mean = np.zeros(len(count))
    random = np.random.default_rng([_SEED, BURN_IN, part])
    for sweep in range(BURN_IN + SAMPLES):
        totals = _totals(houses, np.bincount(house, tables, len(houses)), shared.tables)[house]
        tables = draw_tables(count, totals - tables, parent, shared.discount, random)
        if sweep >= BURN_IN:
            totals = _totals(houses, np.bincount(house, tables, len(houses)), shared.tables)[house]
            mean += (np.maximum(count - shared.discount * tables, 0)
                     + (STRENGTH + shared.discount * totals) * parent) / (STRENGTH + customers)
    return mean / SAMPLES


# --- root ---

class Root(NamedTuple):
    """(word, n, p) of the known words and the path of their table; probability of an unknown one;
    number of known words."""

    words: DataFrame
    path: str
    unknown: float
    known: int


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Small batches as tables of about WORDS rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= WORDS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _root_tables(discount: float, parent: float, others: float, number: int):
    """Tables of words in the root; chance depends on the word alone, so that the order and number
    of batches do not matter."""
    def large(customers: int, word: int) -> int:
        random = np.random.default_rng([_SEED, number, word])
        random.random()  # draw_tables takes one for each cell
        return seat_one(customers, (STRENGTH + discount * others) * parent, discount, random)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _together(batches):
            word, n, r = (batch.column(c).to_numpy() for c in ("word", "n", "r"))
            code = word.view(np.uint64)
            few = r <= EXACT
            mixed = _mixed(code + np.uint64(number))
            tables = draw_tables(np.where(few, r, 0), np.full(len(r), others), np.full(len(r), parent), discount,
                                 np.random.default_rng(_SEED), (mixed >> np.uint64(11)) / 2.0 ** 53)
            many = np.flatnonzero(~few)
            tables[many] = [large(x, w) for x, w in zip(r[many].tolist(), code[many].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (word, n, r, tables)],
                                             names=["word", "n", "r", "t"])

    return fn


def seat_root(counts: DataFrame, number: int) -> Root:
    """Seats the root from (word, n, r): training tokens and customers in the root."""
    spark = counts.sparkSession
    at, path = (scratch_dir(spark) + "/table" for _ in range(2))
    sums = stored(counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("r").alias("r")).where("n > 0"), at)
    of = sums.agg(F.count(F.lit(1)).alias("known"), F.sum("r").alias("r"), F.count_if(F.col("r") == 1).alias("ones"),
                  F.count_if(F.col("r") == 2).alias("twos")).first()
    known, customers, discount = of["known"], of["r"] or 0, _discount(of["ones"], of["twos"])
    # the tables of the others are close to the number of known words, as the base is uniform
    seated = stored(sums.mapInArrow(_root_tables(discount, 1 / (known + 1), max(known - 1, 0), number),
                                    "word long, n long, r long, t long"), path)
    emptied(spark, at)
    tables = seated.agg(F.sum("t")).first()[0] or 0
    back = (STRENGTH + discount * tables) / (known + 1)
    p = (F.greatest(F.col("r") - discount * F.col("t"), F.lit(0.0)) + back) / (STRENGTH + customers)
    return Root(seated.select("word", "n", p.alias("p")), path, back / (STRENGTH + customers), known)


class Table:
    """Seating of the frequent pairs."""

    def __init__(self, counts: np.ndarray, begin: int):
        self.counts = counts
        self.word, place = np.nonzero(counts)
        self.count = counts[self.word, place]
        self.place, self.code = place, np.where(place == counts.shape[0], begin, place)
        self.tables = np.ones(len(self.count), np.int64)
        self.random = np.random.default_rng([_SEED, begin])

    def sweep(self, shared: Shared, p: np.ndarray) -> None:
        self.tables = draw_tables(self.count, shared.tables[self.code] - self.tables, p[self.word],
                                  shared.discount, self.random)

    def log_predictive(self, shared: Shared, p: np.ndarray, begin: int) -> np.ndarray:
        """log10 by (word, column)."""
        codes = np.append(np.arange(self.counts.shape[0]), begin)
        mean = np.zeros(self.counts.shape)
        for _ in range(SAMPLES):
            self.sweep(shared, p)
            own = np.zeros(self.counts.shape)
            own[self.word, self.place] = np.maximum(self.count - shared.discount * self.tables, 0)
            mean += (own + (STRENGTH + shared.discount * shared.tables[codes]) * p[:, None]) / (
                STRENGTH + shared.customers[codes]) / SAMPLES
        return np.log10(mean)


def _texts(numbers, logs, parts: int, tokens: int, known: int):
    """Sums over the tokens of each text of a slice, from the answers of the parts."""
    def fn(key: tuple, slices: pa.Table, answers: pa.Table) -> pa.Table:
        row = slices.combine_chunks().to_batches()[0]
        t = Tokens(next(_each(row.select(_WORK))), numbers.value)
        log_p, log_base = logs.value
        n_texts, doc = len(t.size), np.repeat(np.arange(len(t.size)), t.size)
        frequent, own = numbers.value.frequent, t.in_table
        cell = t.table_cells(own, frequent)
        sums = {"score": np.bincount(doc[own], log_p.ravel()[cell], n_texts),
                "base": np.bincount(doc[own], log_base[cell // (frequent + 1)], n_texts),
                "known": np.bincount(doc[own], minlength=n_texts)}
        if len(answers):
            answers = answers.sort_by("part")
            of, doc = t.cells(parts)[3], doc[~own]
            log_p = np.concatenate([_unpacked_floats(x.as_buffer()) for x in answers.column("score")])
            n = np.concatenate([_unpacked(x.as_buffer(), 8) for x in answers.column("n")])
            log_base = np.log10((n + 0.5) / (tokens + 0.5 * (known + 1)))
            for name, value in (("score", log_p), ("base", log_base), ("known", n > 0)):
                sums[name] = sums[name] + np.bincount(doc, value[of], n_texts)
        train = np.frombuffer(row.column("train")[0].as_buffer(), "u1") > 0
        return pa.table([row.column("keys").flatten(), pa.array(~train), pa.array(t.size),
                         pa.array(np.rint(sums["known"]).astype(np.int64)), pa.array(sums["base"]),
                         pa.array(sums["score"])],
                        names=["_key", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return fn


class Model(NamedTuple):
    """A fitted model: the numbered words, what all parts share, the number of known words, the parts, what
    the root answers to them, and the frequent pairs."""

    numbers: object
    parts: int
    tokens: int
    shared: Shared
    known: int
    held: DataFrame
    answers: DataFrame
    log_table: np.ndarray
    log_base: np.ndarray


def fit(slices: DataFrame) -> Model:
    """Counts and samples the seating of the slices.  Tables and shuffles go when nobody reads them any more."""
    spark = slices.sparkSession
    words, frequent, tokens, chars = numbered_words(slices)
    numbers, begin = spark.sparkContext.broadcast(Numbers.of(words, frequent)), len(words)
    table = Table(frequent_table(slices, numbers), begin)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chars // PART_CHARS)
    held = bucketed(slices.select(*_WORK).mapInArrow(_deal(numbers, parts), "part long, slice long, rare binary, numbers binary")
                    .groupBy("part").applyInPandas(_gather, _HELD_DDL), "part", parts)
    counts_at, at = (scratch_dir(spark) + "/table" for _ in range(2))
    counts = stored(_rows(held.select("words", "tokens", "alone"), _word_counts, "word", "n", "r")
                    .groupBy("word").agg(F.sum("n").alias("n"), F.sum("r").alias("r")), counts_at)
    of = held.agg(F.sum("ones").alias("ones"), F.sum("twos").alias("twos")).first()
    discount = _discount((of["ones"] or 0) + (table.count == 1).sum(), (of["twos"] or 0) + (table.count == 2).sum())
    kind = "part long, " + ", ".join(f"{c} binary" for c in _CELLS)
    cells = stored(held.select("part", "words", "houses", "word_at", "n", "runs").mapInArrow(
        _as_rows(_several, {"part": pa.int64()} | dict.fromkeys(_CELLS, pa.binary())), kind), at)
    for number in range(BURN_IN + 1):
        shared = Shared(discount, *_collected(cells, table, begin))
        own = [(int(w), int(n), int(t)) for w, (n, t) in enumerate(zip(
            table.counts.sum(axis=1), np.bincount(table.word, table.tables, frequent)))]
        more = _rows(cells.select("codes", "code_at", "tables"), _word_tables, "word", "n", "r")
        root = seat_root(reduce(DataFrame.unionByName, [
            counts, more, spark.createDataFrame(own, "word long, n long, r long")]), number)
        p = np.full(frequent, root.unknown)
        n = np.zeros(frequent)
        for r in root.words.where(F.col("word").between(0, frequent - 1)).collect():
            p[r["word"]], n[r["word"]] = r["p"], r["n"]
        if number < BURN_IN:
            table.sweep(shared, p)
            before, at = at, scratch_dir(spark) + "/table"
            cells = stored(cells.groupBy("part").cogroup(ask(cells, "codes", root, parts).groupBy("part"))
                           .applyInPandas(_sweep(shared, number), kind), at)
            for path in (before, root.path):
                emptied(spark, path)
    for path in (counts_at, at):
        emptied(spark, path)
    answers = stored(ask(held, "words", root, parts))
    emptied(spark, root.path)
    return Model(numbers, parts, tokens, shared, root.known, held, answers, table.log_predictive(shared, p, begin),
                 np.log10((n + 0.5) / (tokens + 0.5 * (root.known + 1))))


def _collected(cells: DataFrame, table: Table, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables and customers of the split restaurants, by number."""
    found = (cells.mapInArrow(_split_totals(begin), "code long, tables long, customers long")
             .groupBy("code").agg(F.sum("tables").alias("tables"), F.sum("customers").alias("customers")).toPandas())
    tables = np.bincount(table.code, table.tables, begin + 1)
    customers = np.bincount(table.code, table.count, begin + 1)
    tables[found["code"]] += found["tables"]
    customers[found["code"]] += found["customers"]
    return tables, customers


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity)."""
    spark = docs.sparkSession
    ship(spark)
    kind = dict(docs.dtypes)[key]
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"),
                       (F.crc32(name.cast("binary")) % 5 != 1).alias("_train"))
    with brief_shuffles(spark):
        slices = coded_slices(rows)
        m = fit(slices)
    scoring = m.held.select("part", "word_at", "n", "houses", "runs", "slices", "sizes", "steps")
    answers = (scoring.groupBy("part").cogroup(m.answers.groupBy("part"))
               .applyInPandas(_score_part(m.shared), _ANSWER))
    logs = spark.sparkContext.broadcast((m.log_table, m.log_base))
    found = (slices.select("keys", *_WORK).groupBy("slice").cogroup(answers.groupBy("slice"))
             .applyInArrow(_texts(m.numbers, logs, m.parts, m.tokens, m.known),
                           f"_key {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"))
    return (found.select(F.col("_key").alias(key), "held_out", "n_tokens", "n_known",
                         F.lit(m.tokens).cast("long").alias("train_tokens"), "base_score", "score")
            .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))))
