"""Characters, word pieces, and a byte-pair vocabulary learned and applied."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import pre_tokens
from ..session import scratch_path
from .joins import BROADCAST_ROWS
from .merges import learn_merges

MERGES = 8000


def char_vocab(docs: DataFrame, text: str) -> DataFrame:
    """(id, ch) of all characters in code point order, ids from 0.

    Texts are reduced to their own distinct characters first. The final numbering is one
    task, over no more rows than Unicode has characters.
    """
    chars = docs.select(F.explode(F.array_distinct(F.split(text, ""))).alias("ch")).where("ch <> ''").distinct()
    return chars.withColumn("id", F.row_number().over(Window.orderBy("ch")) - 1)


def pretoken_counts(docs: DataFrame, text: str) -> DataFrame:
    """(piece, n) over all texts."""
    return (docs.select(F.explode(pre_tokens(F.col(text))).alias("piece"))
            .groupBy("piece").agg(F.count(F.lit(1)).alias("n")))


def bpe_learn(docs: DataFrame, text: str, n_merges: int = MERGES, **bounds: int) -> list[tuple[str, str]]:
    """Merges by rank, as hex symbol pairs, most frequent pair first, smaller pair on ties.

    Text is read once: it is reduced to distinct word pieces with counts, from which
    `operators.merges` learns. Fewer merges come back when no pair is left.
    """
    path = scratch_path(docs.sparkSession, "bpe-counts")
    counted = pretoken_counts(docs, text)
    counted.write.parquet(path)
    return learn_merges(docs.sparkSession.read.schema(counted.schema).parquet(path), n_merges, **bounds)


def bpe_vocab(merges: list[tuple[str, str]], special: list[str]) -> dict[str, int]:
    """Ids: special tokens, the 256 bytes, then merges. A symbol made twice keeps one id."""
    ids = {s: i for i, s in enumerate(special)}
    for symbol in [f"{b:02X}" for b in range(256)] + [a + b for a, b in merges]:
        ids.setdefault(symbol, len(ids))
    return ids


def merge_symbols(piece: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """One word piece: the pair of the lowest rank is merged, the first of several, until none is
    left. A heap of places keeps long pieces from taking the square of their length."""
    symbols: list[str | None] = [f"{b:02X}" for b in piece.encode()]
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i, *p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if symbols[i] == a else n
        if j >= n or symbols[j] != b:  # one of the two has been merged since
            continue
        symbols[i], symbols[j] = a + b, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (pair := (symbols[i], symbols[k])) in ranks:
                heapq.heappush(heap, (ranks[pair], i, *pair))
        if (h := before[i]) >= 0 and (pair := (symbols[h], symbols[i])) in ranks:
            heapq.heappush(heap, (ranks[pair], h, *pair))
    return [s for s in symbols if s is not None]


def special_pieces(text: Column, special: list[str]) -> Column:
    """Word pieces with special tokens kept whole, longer ones first."""
    if not special:
        return pre_tokens(text)
    quoted = "|".join(rf"\Q{s}\E" for s in sorted(special, key=lambda s: (-len(s), s)))
    # The earliest token wins, the longest where two start together.
    found = F.regexp_extract_all(text, F.lit(f"({quoted})"), F.lit(1))
    gaps = F.split(text, quoted, -1)
    return F.flatten(F.zip_with(gaps, found, lambda gap, token: F.concat(
        pre_tokens(gap), F.when(token.isNotNull(), F.array(token)).otherwise(F.array().cast("array<string>")))))


def piece_ids(counted: DataFrame, merges: list[tuple[str, str]], special: list[str]) -> DataFrame:
    """(piece, n, ids) of distinct pieces (piece, n): each is merged once."""
    ids = bpe_vocab(merges, special)
    ranks = {pair: i for i, pair in reversed(list(enumerate(merges)))}
    reserved = set(special)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(ids=[[ids[p]] if p in reserved else [ids[s] for s in merge_symbols(p, ranks)] for p in b["piece"]])
    spread = counted.repartition(counted.sparkSession.sparkContext.defaultParallelism, "piece")
    return spread.select("piece", "n").mapInPandas(encode, "piece string, n bigint, ids array<int>")


def bpe_encode(rows: DataFrame, keys: list[str], pieces: Column, merges: list[tuple[str, str]], special: list[str],
               keep: list[str] = (), out: str = "ids", block: int = BROADCAST_ROWS) -> DataFrame:
    """(keys, keep, out): the ids of each row's pieces, by a table piece -> ids built once in Spark.

    `keys` name a row. Up to `block` distinct pieces the table is broadcast. Of a larger one the
    `block` most frequent pieces are, and the places of the others, none of which is frequent, meet
    the table in a shuffled join. A row without pieces has no ids.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "bpe-ids")
    placed = rows.select(*keys, *keep, F.posexplode_outer(pieces).alias("_at", "piece"))
    counted = rows.select(F.explode(pieces).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    piece_ids(counted, merges, special).write.parquet(path)
    table = spark.read.parquet(path)
    names = [*keys, *keep, "_at"]
    if table.limit(block + 1).count() <= block:
        found = placed.join(F.broadcast(table.select("piece", "ids")), "piece", "left").select(*names, "ids")
    else:
        often = table.orderBy(F.desc("n"), "piece").limit(block).select("piece", "ids")
        first = placed.join(F.broadcast(often), "piece", "left")
        rare = first.where("ids IS NULL AND piece IS NOT NULL").drop("ids").join(table.select("piece", "ids"), "piece")
        found = first.where("ids IS NOT NULL OR piece IS NULL").select(*names, "ids").unionByName(rare.select(*names, "ids"))
    places = F.sort_array(F.collect_list(F.struct("_at", "ids")))
    return found.groupBy(*keys).agg(*[F.first(c).alias(c) for c in keep], F.flatten(F.transform(
        places, lambda p: F.coalesce(p["ids"], F.array().cast("array<int>")))).alias(out))


def bpe_decode(ids: Column, merges: list[tuple[str, str]], special: list[str]) -> Column:
    """Text of an id list."""
    names = sorted(bpe_vocab(merges, special).items(), key=lambda kv: kv[1])
    table = F.array(*[F.lit(k.encode().hex().upper() if k in special else k) for k, _ in names])
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")), "UTF-8")
