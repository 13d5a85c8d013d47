"""Language-model scores from a hierarchical Pitman-Yor process fitted on the whole training part of a corpus.

Restaurants, from the bottom up:

* words in context: one restaurant for each previous word of the corpus (and for the end of a text), with every word that
  follows it as a dish (`word_pairs`); parent: the product of the next two;
* symbols: the `symbols` most frequent words, the end of a text, and one symbol for rare words of each last byte; one
  restaurant for each previous symbol; parent: one for all symbols, then uniform;
* rare words: one restaurant for each last byte, with every rare word of the corpus and one dish for all unknown words;
  parent: uniform over these dishes.

A text's probability is the product over its tokens of P(word | previous word), which backs off to P(symbol | previous
symbol) and, for rare words, P(word | last byte). Tables of a restaurant are the customers of its parent. Seating is Gibbs sampling
by blocks: all customers of a dish leave and sit down at once, by the exact law of their number of tables (`seating`).
`rounds` times all pairs are seated and their parents fitted on the tables. Predictive probabilities are averaged over `samples`
seatings. Words and pairs are counted, seated and looked up in Spark; only tables of a fixed greatest size
are held on the driver (symbols x symbols and the `known` most frequent words).

Defined cases: a null or empty text is its end alone; repeated rows are scored each and learnt each; without training
texts every distribution is uniform; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packwise.llm import word_pairs
from packwise.llm.seating import drawn_tables
from packwise.llm.tables import drop_old_shuffles, rows_of, staged, texts_of, tidied
from packwise.llm.words import NOT_BLANK, Words, mix, words_of


SWEEPS = 2  # after the first one the weights of new tables come from the tables that were drawn


def seatings(customers: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator, samples: int, moves: int = 1) -> np.ndarray:
    """Sampled numbers of tables, (samples, dishes). fresh: weight of a new table of each dish, that is
    (concentration + discount * tables of the restaurant) * probability of the dish in the parent. A move seats every customer
    anew by the exact law, so further moves do not change it."""
    return drawn_tables(customers, fresh, discount, rng.integers(0, 1 << 64, (samples, len(customers)), np.uint64))


def discount_of(counts: np.ndarray, weights: np.ndarray | None = None) -> float:
    """The usual estimate from dishes with one and with two customers."""
    weights = np.ones(len(counts)) if weights is None else weights
    one, two = weights[counts == 1].sum(), weights[counts == 2].sum()
    return float(np.clip(one / (one + 2 * two), 0.1, 0.95)) if one + two else 0.5


def restaurants(rows: np.ndarray, dishes: np.ndarray, counts: np.ndarray, parent: np.ndarray, n_rows: int, rng: np.random.Generator, samples: int, concentration: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Seat the customers of many restaurants under one parent. parent: probability of each (restaurant, dish) entry.
    Returns sampled tables of the entries, all customers and sampled tables of each restaurant, and the discount."""
    discount = discount_of(counts)
    total = np.bincount(rows, counts, n_rows)
    # the number of tables of a restaurant enters each dish's weights; it starts at the usual power of its customers
    tables = np.maximum(np.bincount(rows, minlength=n_rows), total**discount)
    for sweep in range(SWEEPS):
        seats = seatings(counts, (concentration + discount * tables[rows]) * parent, discount, rng, samples if sweep + 1 == SWEEPS else 1)
        tables = np.bincount(rows, seats[0], n_rows)
    each = np.stack([np.bincount(rows, s, n_rows) for s in seats])
    return seats, total, each, np.array([concentration]), discount


@dataclass
class Lists:
    """The most frequent words: sorted keys with their counts; symbol: number below `symbols`, or -1; own: that number, or the
    symbol of the last byte."""

    keys: np.ndarray
    counts: np.ndarray
    symbol: np.ndarray
    own: np.ndarray
    symbols: int

    @property
    def size(self) -> int:
        return self.symbols + 1 + 256

    def _place(self, hashes: np.ndarray) -> np.ndarray:
        """Index of the first key that is not smaller, or of the last: from a table by leading bits, since hashes are evenly spread."""
        shift = np.uint64(64 - max(1, int(len(self.keys)).bit_length() + 1))
        if "_table" not in self.__dict__:  # made where it is used
            heads = np.arange(1 << (64 - int(shift)), dtype=np.uint64) << shift
            self._table = np.minimum(np.searchsorted(self.keys, heads), len(self.keys) - 1).astype(np.int32)
        at = self._table[hashes >> shift]
        behind = np.flatnonzero(self.keys[at] < hashes)
        while len(behind):
            at[behind] += 1
            behind = behind[at[behind] < len(self.keys) - 1]
            behind = behind[self.keys[at[behind]] < hashes[behind]]
        return np.minimum(at, len(self.keys) - 1)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_table"}

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Index of each word in the list (-1: not there), and its symbol."""
        if len(self.keys):
            at = self._place(words.hashes)
            at = np.where(self.keys[at] == words.hashes, at, -1)
        else:
            at = np.full(len(words.hashes), -1)
        last = self.symbols + 1 + words.data[words.ends - 1].astype(np.int64)
        return at, np.where(at >= 0, self.own[at], last) if len(self.keys) else last


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(key, word, n) of all words of all texts; of a word only its last byte is kept."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            words = words_of(texts_of(batch.column(0)), NOT_BLANK)
            keys, index, n = np.unique(words.hashes, return_index=True, return_counts=True)
            last = pa.FixedSizeBinaryArray.from_buffers(pa.binary(1), len(index), [None, pa.py_buffer(words.data[words.ends[index] - 1])]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), last, pa.array(n.astype(np.int64))], names=["key", "word", "n"])

    made = docs.select(text).mapInArrow(tidied(count), "key bigint, word binary, n bigint")
    return made.groupBy("key", "word").agg(F.sum("n").alias("n"))


def last_byte() -> Column:
    return F.conv(F.hex(F.expr("substring(word, length(word), 1)")), 16, 10).cast("int")


def _frequent(lexicon: DataFrame, known: int, symbols: int) -> Lists:
    """The words above the count that leaves `known` of them at most; ties at the edge stay out together."""
    sizes = sorted(((r.n, r.words) for r in lexicon.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True)
    least, total = None, 0
    for n, words in sizes:
        if total + words > known:
            break
        least, total = n, total + words
    rows = lexicon.where(F.col("n") >= (least if total else 2**62)).select("key", "n", last_byte().alias("last")).toArrow()  # at most `known`
    keys, counts, last = (rows.column(c).to_numpy() for c in ("key", "n", "last"))
    order = np.lexsort((keys, -counts))
    keys, counts, last, symbol = keys[order].view(np.uint64), counts[order], last[order], np.arange(len(order))
    symbol[symbol >= symbols] = -1
    order = np.argsort(keys)
    keys, counts, symbol = keys[order], counts[order], symbol[order]
    return Lists(keys, counts, symbol, np.where(symbol >= 0, symbol, symbols + 1 + last[order]), symbols)


def symbol_model(pairs: DataFrame, size: int, samples: int, rounds: int = 2, upper: np.ndarray | None = None) -> np.ndarray:
    """log10 P(symbol | previous symbol), (size, size). Restaurants are seated in Spark, each whole in one group; all of them have
    at most size * size rows. upper: customers of the restaurant above all, where the sampling starts; they are
    changed to those it ends with."""
    pairs = staged(pairs.select(F.expr(f"cast(pair div {size} as int)").alias("before"), F.expr(f"cast(pair % {size} as int)").alias("symbol"), "n"))
    ones = pairs.agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).first()
    discount = discount_of(np.array([1, 2]), np.array([ones.one, ones.two])) if ones.one + ones.two else 0.5
    upper = np.zeros(size, np.int64) if upper is None else upper
    if not upper.any():
        for r in pairs.groupBy("symbol").agg(F.count("*").alias("n")).collect():
            upper[r.symbol] = r.n
    for k in range(rounds):
        parent = _top(upper, np.random.default_rng(11 + k), samples)
        seat = _seat_symbols(parent, discount, samples, k)
        # dealt in as many groups as tasks: a few rows with many customers are much work
        tasks = 2 * pairs.sparkSession.sparkContext.defaultParallelism
        dealt = pairs.withColumn("slot", F.col("before") % tasks).repartition(tasks, "slot")
        seated = staged(dealt.groupBy("slot").applyInPandas(seat, "before int, symbol int, n long, tables array<long>"))
        mean = seated.groupBy("symbol").agg(F.sum(F.expr("aggregate(tables, 0D, (a, t) -> a + t)") / samples).alias("t")).collect()
        upper[:] = 0
        for r in mean:
            upper[r.symbol] = max(1, round(r.t))
    parent = _top(upper, np.random.default_rng(29), samples)
    rows = seated.select("before", "symbol", "n", *[F.col("tables")[s].alias(f"t{s}") for s in range(samples)]).toArrow()
    before, symbol, n = (rows.column(c).to_numpy() for c in ("before", "symbol", "n"))  # at most size * size
    out, total = np.zeros((size, size)), np.bincount(before, n, size)
    for s in range(samples):
        t = rows.column(f"t{s}").to_numpy()
        own = np.zeros((size, size))
        own[before, symbol] = n - discount * t
        out += (own + (1 + discount * np.bincount(before, t, size))[:, None] * parent) / (1 + total)[:, None]
    return np.log10(out / samples).astype(np.float32)


def _seat_symbols(parent: np.ndarray, discount: float, samples: int, k: int):
    """Seats whole restaurants; random numbers come from the pair, so it does not matter which restaurants come together."""

    def seat(rows: pd.DataFrame) -> pd.DataFrame:
        n, before, symbol = (rows[c].to_numpy() for c in ("n", "before", "symbol"))
        with np.errstate(over="ignore"):
            pair = mix(mix((before.astype(np.uint64) << np.uint64(32)) + symbol.astype(np.uint64)) + mix(np.array([17 + k], np.uint64)))
            seeds = np.stack([mix(pair + np.uint64(s)) for s in range(SWEEPS + samples - 1)])
        tables = np.maximum(np.bincount(before), np.bincount(before, n) ** discount)
        for sweep in range(SWEEPS):
            own = seeds[sweep : sweep + 1] if sweep + 1 < SWEEPS else seeds[sweep:]
            seats = drawn_tables(n, (1 + discount * tables[before]) * parent[symbol], discount, own)
            tables = np.bincount(before, seats[0])
        return rows.drop(columns="slot").assign(tables=[x.tolist() for x in seats.T])

    return seat


def _top(customers: np.ndarray, rng: np.random.Generator, samples: int) -> np.ndarray:
    """Predictive probabilities of the one restaurant above all symbols, over the uniform distribution."""
    dishes = np.flatnonzero(customers)
    flat = np.full(len(customers), 1 / len(customers))
    seats, total, tables, con, d = restaurants(np.zeros_like(dishes), dishes, customers[dishes], flat[dishes], 1, rng, samples)
    out = np.zeros(len(customers))
    for s, t in zip(seats, tables, strict=True):
        own = np.zeros(len(customers))
        own[dishes] = customers[dishes] - d * s
        out += (own + (con + d * t) * flat) / (con + total)
    return out / samples


@dataclass
class RareWords:
    """What the restaurants of rare words need besides the words themselves, by last byte."""

    discount: float
    customers: np.ndarray
    tables: np.ndarray
    types: np.ndarray

    def new_weight(self) -> np.ndarray:
        """Weight of a new table of any one dish."""
        return (1 + self.discount * self.tables) / (self.types + 1)

    def unknown(self) -> np.ndarray:
        """log10 probability of the dish for unknown words."""
        return np.log10(self.new_weight() / (1 + self.customers))


def rare_model(rare: DataFrame, samples: int) -> tuple[RareWords, DataFrame]:
    """Fit on (key, word, n) of rare words. Returns the model and (key, n, log_p) with the other columns."""
    few = rare.agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).first()
    discount = discount_of(np.array([1, 2]), np.array([few.one, few.two])) if few.one + few.two else 0.5
    others = [c for c in rare.columns if c not in ("key", "word", "n")]
    rare = rare.select("key", "n", last_byte().alias("last"), *others)
    customers, types = np.zeros(256), np.zeros(256)
    for r in rare.groupBy("last").agg(F.sum("n").alias("n"), F.count("*").alias("t")).collect():  # 256 rows
        customers[r["last"]], types[r["last"]] = r.n, r.t
    model = RareWords(discount, customers, types.copy(), types)
    seated = staged(_seat_words(rare, model, samples))
    mean = F.expr("aggregate(tables, 0D, (a, t) -> a + t)") / samples
    for r in seated.groupBy("last").agg(F.sum(mean).alias("t")).collect():
        model.tables[r["last"]] = r.t
    # linear in the tables, so the mean of the tables gives the average over samples
    by_last = seated.sparkSession.createDataFrame(
        [(k, float(model.customers[k]), float(model.new_weight()[k])) for k in range(256)], "last int, customers double, fresh double"
    )
    p = (F.col("n") - discount * mean + F.col("fresh")) / (1 + F.col("customers"))
    return model, seated.join(F.broadcast(by_last), "last").select("key", "n", F.log10(p).alias("log_p"), *others)  # 256 rows


def _seat_words(rare: DataFrame, model: RareWords, samples: int, most: int = 20_000) -> DataFrame:
    """Seated in buckets of about `most` words, dealt by key and sorted by it: a bucket's random numbers start from its own
    number, so that a repeated task and another number of partitions give the same seats."""
    buckets = max(1, -(-int(model.types.sum()) // most))
    fresh = model.new_weight()

    def seat(words: pd.DataFrame) -> pd.DataFrame:
        words = words.sort_values(["key", "n"])
        rng = np.random.default_rng([23, int(words["bucket"].iloc[0])])
        seats = seatings(words["n"].to_numpy(), fresh[words["last"].to_numpy()], model.discount, rng, samples)
        return words.drop(columns="bucket").assign(tables=[x.tolist() for x in seats.T])

    dealt = rare.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rare.schema)
    return dealt.groupBy("bucket").applyInPandas(seat, f"{fields}, tables array<bigint>")


def scored(
    docs: DataFrame, held_out: Column, keep: list[str], *, text: str = "text", known: int = 1 << 18, symbols: int = 512, samples: int = 3,
    rounds: int = 2, bucket_tokens: int = 1_000_000,
) -> DataFrame:
    """The columns in keep as `doc`, and held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    train = docs.where(~held_out)
    lexicon = staged(word_counts(train, text))
    all_words = lexicon.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("words")).first()
    ends, texts = train.count(), docs.count()
    tokens, vocabulary = all_words.n + ends, all_words.words + (ends > 0)
    lists = _frequent(lexicon, known, symbols)
    buckets = max(1, -(-(tokens * texts // max(1, ends)) // bucket_tokens))
    pairs = staged(word_pairs.pair_counts(docs, held_out, text, lists, buckets))
    parent, counts = _first_parent(pairs, lists, samples)
    upper = np.zeros(lists.size, np.int64)
    for k in range(rounds):  # a sweep over all levels, from the bottom up
        drop_old_shuffles(docs.sparkSession)
        seats = word_pairs.seats(pairs, parent, counts)
        share = 10.0 ** symbol_model(_rows_of(docs.sparkSession, seats.symbols), lists.size, samples, 1, upper).astype(float)
        rare = seats.words.groupBy("key", "last").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).where("n > 0")
        model, predictive = rare_model(rare.select("key", F.unhex(F.lpad(F.hex("last"), 2, "0")).alias("word"), "n", "c"), samples)
        predictive = staged(predictive)
        of_list = docs.sparkSession.createDataFrame(pa.table({"key": lists.keys.view(np.int64)}), "key bigint")
        rows = predictive.join(F.broadcast(of_list), "key", "left_semi").select("key", "log_p").toArrow()
        known_rare = np.ones(len(lists.keys))
        known_rare[np.searchsorted(lists.keys, rows.column("key").to_numpy().view(np.uint64))] = 10.0 ** rows.column("log_p").to_numpy()
        if k + 1 < rounds:
            parent = word_pairs.Parent(lists, share, known_rare, parent.customers, seats.spread[1], parent.discount, samples)
    own, new = word_pairs.own_and_new(*seats.dense, *(x[:, None] for x in seats.spread), parent.discount)
    top = symbols + 1
    dense = np.log10(own + new * share[:top, :top])
    shares = seats.words.where("bucket is not null").select("bucket", "key").join(predictive.select("key", "log_p", "c"), "key")
    drop_old_shuffles(docs.sparkSession)
    scores = word_pairs.Scores(parent, share, known_rare, model.unknown(), seats.spread, dense, ends, buckets)
    found = scores.scored(docs, held_out, text, keep, shares)
    return found.select(
        "doc", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(tokens + vocabulary + 1)))).alias("base_score"), "score",
    )


def _first_parent(pairs: DataFrame, lists: Lists, samples: int) -> tuple[word_pairs.Parent, np.ndarray]:
    """Shares by plain counts, where the sampling starts, and the counts of (symbol before, symbol)."""
    counts, types, once, twice = word_pairs.first_sums(pairs, lists)
    discount = discount_of(np.array([1, 2]), np.array([once, twice])) if once + twice else 0.5
    flat = (counts.sum(0) + 1) / (counts.sum() + lists.size)
    share = (counts + flat) / (counts.sum(1, keepdims=True) + 1)
    customers = counts[:, lists.symbols + 1 :].sum(0)  # of the restaurants of rare words
    rare = np.ones(len(lists.keys))
    listed = lists.symbol < 0
    rare[listed] = lists.counts[listed] / (1 + customers[lists.own[listed] - lists.symbols - 1])
    top = lists.symbols + 1
    tables = np.maximum(types, counts[:top].sum(1) ** discount)
    return word_pairs.Parent(lists, share, rare, customers, tables, discount, samples), counts


def _rows_of(spark: SparkSession, counts: np.ndarray) -> DataFrame:
    """(pair, n) of a matrix of counts."""
    seen = np.flatnonzero(counts)
    return spark.createDataFrame(pa.table({"pair": seen, "n": counts.ravel()[seen]}), "pair bigint, n bigint")
