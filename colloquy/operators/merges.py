"""Learning byte-pair merges: pair counts kept by delta, pieces found through an inverted table.

The text is reduced to distinct pieces with counts by Spark. The HEAD most frequent short ones
(a fixed bound) are counted on the driver, where a merge changes the counts of the pairs around
it only. All other pieces stay in Spark, as a table pair -> pieces, and are asked in rounds: the
driver foretells the next merges from its own counts and what it knows of the rest, one job looks
up the pieces that hold those pairs, merges in them and sums what every merge changes, and the
driver then takes the foretold merges for as long as each is the most frequent pair by exact
counts. The first one always is. One that comes out before others foretold ahead of it is taken all
the same where it does not meet them in any piece, as then its changes are the same in both orders.
A round costs what the pieces it looks up cost; the whole table is read again only every EPOCH
merges, to renew it, or when the listed pairs are used up.

A pair that is not among the LISTED ones is at most as frequent as the last of them (`floor`),
and counts of old pairs only fall, so no merge is taken at or below the floor without a new list.
What comes back from a round is bounded by the vocabulary: a merge (a, b) changes pairs (x, a),
(b, y) and makes (x, ab), (ab, y).
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

HEAD = 200_000     # pieces counted on the driver
HEAD_CHARS = 64    # of at most so many characters
LISTED = 200_000   # pairs of the other pieces whose counts the driver knows
EPOCH = 1000       # merges between renewals of the inverted table
BUCKETS = 256
MOST_FORETOLD = 512

Pair = tuple[str, str]


def merged(symbols: list[str], pair: Pair) -> list[str]:
    """Every place of the pair, from the left, as one symbol."""
    out, i, (a, b) = [], 0, pair
    while i < len(symbols):
        if i + 1 < len(symbols) and symbols[i] == a and symbols[i + 1] == b:
            out.append(a + b)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def advance(symbols: list[str], steps: dict[Pair, Sequence[int]], seen: Callable[[int, list[str], list[str]], None] | None = None) -> list[str]:
    """The symbols after merges in their order. `steps` has the numbers of each pair's merges."""
    last = -1
    while True:
        nexts = [n for p in set(zip(symbols, symbols[1:])) for n in steps.get(p, ()) if n > last]
        if not nexts:
            return symbols
        last = min(nexts)
        pair = next(p for p in zip(symbols, symbols[1:]) if last in steps.get(p, ()))
        after = merged(symbols, pair)
        if seen is not None:
            seen(last, symbols, after)
        symbols = after


def numbered(merges: Sequence[Pair]) -> dict[Pair, list[int]]:
    steps: dict[Pair, list[int]] = defaultdict(list)
    for i, pair in enumerate(merges):
        steps[pair].append(i)
    return dict(steps)


class Counted:
    """Pieces with how often they occur, their pair counts, and where each pair may stand."""

    def __init__(self, words: Sequence[tuple[list[str], int]]):
        self.words = [w for w, _ in words]
        self.n = [n for _, n in words]
        self.count: Counter[Pair] = Counter()
        self.where: dict[Pair, set[int]] = defaultdict(set)
        for i, w in enumerate(self.words):
            for p in zip(w, w[1:]):
                self.count[p] += self.n[i]
                self.where[p].add(i)

    def _put(self, i: int, symbols: list[str], changes: Counter[Pair]) -> None:
        n, old = self.n[i], self.words[i]
        for p in zip(old, old[1:]):
            changes[p] -= n
        for p in zip(symbols, symbols[1:]):
            changes[p] += n
            self.where[p].add(i)
        self.words[i] = symbols

    def _count(self, changes: Counter[Pair]) -> None:
        for p, d in changes.items():
            self.count[p] += d

    def merge(self, pair: Pair) -> tuple[Counter[Pair], list[tuple[int, list[str]]]]:
        """What the merge changes, and the pieces it changed as they were."""
        changes: Counter[Pair] = Counter()
        before = []
        for i in self.where[pair]:
            old = self.words[i]
            new = merged(old, pair)
            if len(new) < len(old):
                before.append((i, old))
                self._put(i, new, changes)
        self._count(changes)
        return changes, before

    def undo(self, before: list[tuple[int, list[str]]]) -> None:
        changes: Counter[Pair] = Counter()
        for i, old in before:
            self._put(i, old, changes)
        self._count(changes)


class Best:
    """The most frequent pair, the smaller one on ties, while counts change."""

    def __init__(self, total: Callable[[Pair], float], pairs: Sequence[Pair]):
        self.total = total
        self.heap = [(-total(p), p) for p in pairs]
        heapq.heapify(self.heap)

    def changed(self, pairs: Sequence[Pair]) -> None:
        for p in pairs:
            if (n := self.total(p)) > 0:
                heapq.heappush(self.heap, (-n, p))

    def top(self) -> tuple[Pair, float] | None:
        while self.heap:
            n, p = self.heap[0]
            now = self.total(p)
            if now > 0 and -n == now:
                return p, now
            heapq.heappop(self.heap)
        return None


class Foretold:
    """Merges with what each changes in the other pieces, applied in the foretold order."""

    def __init__(self, merges: Sequence[Pair], changes: Sequence[dict[Pair, int]]):
        self.left = list(zip(merges, changes))
        self.symbols = {id(c): {s for p in c for s in p} for c in changes}

    def take(self, pair: Pair) -> dict[Pair, int] | None:
        """What the merge changes if it comes next; None if that is not known."""
        at = next((i for i, (p, _) in enumerate(self.left) if p == pair), None)
        if at is None or not all(self._apart(*earlier, *self.left[at]) for earlier in self.left[:at]):
            return None
        return self.left.pop(at)[1]

    def _apart(self, before: Pair, its: dict[Pair, int], pair: Pair, changes: dict[Pair, int]) -> bool:
        """Nowhere do the two share a symbol or stand side by side, and neither makes a symbol of
        the other, so either may come first.

        After the earlier one, a place of the later one beside it would have its symbol, and a
        place they shared would be missing from the later one's count.
        """
        made = before[0] + before[1]
        return pair not in its and made not in self.symbols[id(changes)] and made not in pair and pair[0] + pair[1] not in before


class Rest:
    """The pieces that stay in Spark, as an inverted table pair -> pieces of the last renewal."""

    def __init__(self, pieces: DataFrame):
        self.spark = pieces.sparkSession
        self.state = self._stored(pieces, "pieces")
        self.merges: list[Pair] = []  # taken since the renewal
        self.count: dict[Pair, int] = {}
        self.floor = 0

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, f"bpe-{name}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def renew(self, head: Counter[Pair], listed: int) -> None:
        """Bring the pieces to where the merges are, index them anew and list their top pairs."""
        if self.merges:
            steps = numbered(self.merges)

            def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    yield pd.DataFrame({"n": b["n"], "symbols": [" ".join(advance(s.split(" "), steps)) for s in b["symbols"]]})
            self.state = self._stored(self.state.mapInPandas(forward, "n bigint, symbols string"), "pieces")
            self.merges = []
        split = F.split("symbols", " ")
        places = F.transform(F.sequence(F.lit(0), F.size(split) - 2), lambda i: F.struct(
            F.get(split, i).alias("a"), F.get(split, i + 1).alias("b")))
        posts = self.state.where(F.contains("symbols", F.lit(" "))).select("n", "symbols", F.explode(places).alias("p")).select(
            "n", "symbols", "p.a", "p.b").withColumn("bucket", bucket_of(F.col("a"), F.col("b")))
        path = scratch_path(self.spark, "bpe-posts")
        spread = self.spark.sparkContext.defaultParallelism
        (posts.repartition(spread, "bucket", F.pmod(F.xxhash64("symbols"), F.lit(4))).sortWithinPartitions("bucket", "a", "b")
         .write.partitionBy("bucket").parquet(path))
        self.posts = self.spark.read.schema(posts.schema).parquet(path)  # files are listed once
        totals = self.posts.groupBy("a", "b").agg(F.sum("n").alias("n"))
        known = [(a, b, n) for (a, b), n in head.items() if n > 0]
        if known:
            totals = totals.join(self.spark.createDataFrame(pd.DataFrame(known, columns=["a", "b", "h"])), ["a", "b"], "left")
        total = F.col("n") + (F.coalesce("h", F.lit(0)) if known else F.lit(0))
        top = totals.select("a", "b", "n", total.alias("t")).orderBy(F.desc("t")).limit(listed + 1).toPandas()
        self.floor = int(top["t"].iloc[listed]) if len(top) > listed else 0
        self.count = {(a, b): int(n) for a, b, n in zip(top["a"][:listed], top["b"][:listed], top["n"][:listed])}

    def borders(self, merges: list[Pair]) -> set[Pair]:
        """Pairs of the inverted table of which a piece holds one if it ever holds a pair of `merges`."""
        lasts: dict[str, set[str]] = defaultdict(set)
        firsts: dict[str, set[str]] = defaultdict(set)
        found: set[Pair] = set()
        for i, (a, b) in enumerate(self.merges + merges):
            # A symbol stood there at the renewal, or was made since in one or several ways.
            tails, heads = lasts[a] | {a}, firsts[b] | {b}
            if i >= len(self.merges):
                found |= {(x, y) for x in tails for y in heads}
            lasts[a + b] |= lasts[b] | {b}
            firsts[a + b] |= firsts[a] | {a}
        return found

    def changes(self, foretold: list[Pair]) -> list[dict[Pair, int]]:
        """What each of the foretold merges changes, in their order."""
        borders = sorted(self.borders(foretold))
        keys = self.spark.createDataFrame(borders, "a string, b string")
        buckets = sorted({zlib.crc32(f"{a} {b}".encode()) % BUCKETS for a, b in borders})
        held = self.posts if len(buckets) == BUCKETS else self.posts.where(F.col("bucket").isin(buckets))
        # Few bytes but much work per piece, so every core gets a share.
        spread = held.join(F.broadcast(keys), ["a", "b"], "left_semi").repartition(
            self.spark.sparkContext.defaultParallelism, "symbols")
        rows = spread.groupBy("symbols").agg(F.first("n").alias("n"))
        steps, first = numbered(self.merges + foretold), len(self.merges)

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                total: Counter[tuple[int, str, str]] = Counter()
                for text, n in zip(batch["symbols"], batch["n"]):
                    def seen(step: int, old: list[str], new: list[str], n: int = int(n)) -> None:
                        if step >= first:
                            for a, b in zip(old, old[1:]):
                                total[step, a, b] -= n
                            for a, b in zip(new, new[1:]):
                                total[step, a, b] += n
                    advance(text.split(" "), steps, seen)
                yield pd.DataFrame([(*k, d) for k, d in total.items() if d], columns=["step", "a", "b", "d"])
        found = rows.mapInPandas(sums, "step bigint, a string, b string, d bigint").groupBy("step", "a", "b").agg(
            F.sum("d").alias("d")).where("d <> 0").toPandas()
        out: list[dict[Pair, int]] = [{} for _ in foretold]
        for step, a, b, d in zip(found["step"], found["a"], found["b"], found["d"]):
            out[step - first][a, b] = int(d)
        return out

    def take(self, pair: Pair, changes: dict[Pair, int]) -> None:
        made = pair[0] + pair[1]
        self.merges.append(pair)
        for p, d in changes.items():
            # An old pair that was not listed stays under the floor; a new one is counted whole.
            if p in self.count or made in p:
                self.count[p] = self.count.get(p, 0) + d


def bucket_of(a: Column, b: Column) -> Column:
    return F.pmod(F.crc32(F.concat_ws(" ", a, b)), F.lit(BUCKETS)).cast("int")


def foretell(head: Counted, rest: Rest, best: Best, n: int) -> list[Pair]:
    """The next merges as far as the driver can tell: elsewhere merges change as much as here."""
    guess: dict[Pair, float] = {}

    def total(p: Pair) -> float:
        return head.count[p] + guess.get(p, rest.count.get(p, 0))
    ahead = Best(total, [])
    ahead.heap = list(best.heap)
    out, undo = [], []
    while len(out) < n and (top := ahead.top()) and top[1] > rest.floor:
        pair = top[0]
        here, there = head.count[pair], total(pair) - head.count[pair]
        changes, before = head.merge(pair)
        undo.append(before)
        share = there / here if here else 0.0
        for p, d in changes.items():
            if p in guess or p in rest.count or share:
                guess[p] = max(0.0, guess.get(p, rest.count.get(p, 0)) + d * share)
        guess[pair] = 0.0
        ahead.changed(list(changes))
        out.append(pair)
    for before in reversed(undo):
        head.undo(before)
    return out


def learn_merges(pieces: DataFrame, n_merges: int, head_pieces: int = HEAD, listed: int = LISTED,
                 epoch: int = EPOCH, rounds: list[int] | None = None) -> list[Pair]:
    """Merges by rank, as hex symbol pairs, most frequent pair first, smaller pair on ties.

    `pieces` is (piece, n). `rounds` gets the number of merges each round took.
    """
    order = [F.desc("n"), F.col("piece")]
    symbols = F.trim(F.regexp_replace(F.hex(F.encode("piece", "UTF-8")), "(..)", "$1 ")).alias("symbols")
    short = F.length("piece") <= HEAD_CHARS
    top = pieces.where(short).orderBy(*order).limit(head_pieces).select("piece", "n", symbols).toPandas()
    one: dict[str, str] = {}  # symbols are shared, not repeated
    head = Counted([([one.setdefault(x, x) for x in s.split(" ")], int(n)) for s, n in zip(top["symbols"], top["n"])])
    others = pieces
    if len(top):
        cut_n, cut = int(top["n"].iloc[-1]), top["piece"].iloc[-1]
        inside = short & ((F.col("n") > cut_n) | ((F.col("n") == cut_n) & (F.col("piece") <= cut)))
        others = pieces.where(~inside)
    others = others.select("n", symbols)
    merges: list[Pair] = []
    if others.isEmpty():
        best = Best(lambda p: head.count[p], list(head.count))
        while len(merges) < n_merges and (found := best.top()):
            merges.append(found[0])
            best.changed(list(head.merge(found[0])[0]))
        return merges

    rest = Rest(others)
    rest.renew(head.count, listed)

    def total(p: Pair) -> int:
        return head.count[p] + rest.count.get(p, 0)
    best = Best(total, list(head.count.keys() | rest.count.keys()))
    room = 32
    while len(merges) < n_merges:
        found = best.top()
        used_up = found is None or found[1] <= rest.floor
        if used_up and rest.floor == 0:
            break
        if used_up or len(rest.merges) >= epoch:
            rest.renew(head.count, listed)
            best = Best(total, list(head.count.keys() | rest.count.keys()))
            continue
        foretold = foretell(head, rest, best, min(room, n_merges - len(merges), max(1, epoch - len(rest.merges))))
        known = Foretold(foretold, rest.changes(foretold))
        taken = 0
        while known.left and (found := best.top()) and found[1] > rest.floor:
            pair = found[0]
            if (changes := known.take(pair)) is None:
                break
            here, _ = head.merge(pair)
            rest.take(pair, changes)
            best.changed(list(here.keys() | changes.keys()))
            merges.append(pair)
            taken += 1
        if rounds is not None:
            rounds.append(taken)
        room = min(MOST_FORETOLD, 2 * room) if taken == len(foretold) else max(16, 2 * taken)
    return merges
