"""Best-fit packing of tokenised documents into fixed-length sequences.

The lengths of all pieces form a histogram of at most `capacity` entries. A configuration says how many pieces of each length
share one sequence. The covering linear program over configurations (fewest sequences such that every length's demand is met)
is solved by multiplicative weights: each step prices the lengths, finds the best configurations by knapsack dynamic programming
and lowers the prices of what they cover. Each step's share is rounded to whole copies as it is taken, and lengths that are covered
leave the program, so the solution is whole when it is complete; prices give a lower bound. Only what no full sequence takes, some
pieces of a length at most, may be placed best-fit by decreasing length instead, counts of equal lengths at a time. Only the
histogram reaches the driver, and its work does not grow with the number of pieces; pieces find their place by their rank among
the pieces of equal length."""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_and_text, stage, table

CAPACITY = 1024
END_ID = 2
#: Steps of the lower bound, and how fast a covered length's price falls in them.
BOUND_STEPS, BOUND_ETA = 96, 0.2
#: In the program's steps: worth of a sequence-long piece beyond its share of the capacity, so that long pieces find partners while
#: short ones are left; how fast prices fall; and the share of the lengths that as many configurations are taken for between two pricings.
LARGE_FIRST, ETA, BLOCK_SHARE = 0.2, 0.2, 32
#: Pieces of one length that are ranked together; longer runs are dealt out over blocks.
BLOCK = 4096

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load_encoder(path: str):
    """text -> uint32 ids of the byte-level BPE vocabulary in a `tokenizers` file, special tokens in the text read as that
    library does by default. The merging runs in tiktoken, which gives the same ids several times faster; a file whose merge
    order is not its id order, which tiktoken needs, and a text that tiktoken stops on are run by `tokenizers` itself."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    vocabulary, merges = own["model"]["vocab"], own["model"]["merges"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"]: t["id"] for t in own["added_tokens"]}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    if [vocabulary[a + b] for a, b in pairs] == sorted(vocabulary[a + b] for a, b in pairs):
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    else:
        fast = None
    slow = []

    def encode(text: str) -> np.ndarray:
        if fast:
            try:
                return fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # its regex engine gives up on very long runs of white space
                pass
        if not slow:
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(path))
        return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of `capacity` but the first, which may be shorter."""
    first = n % capacity or capacity
    starts = [0, *range(first, n, capacity)]
    return [(s, (first if s == 0 else capacity)) for s in starts]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(path)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text), end_id).astype("<u4")
                rows += [(doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, _PIECES)


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(best, pick): the most value that fits each capacity (each length any number of times), and the length that the best filling
    of exactly this capacity takes last, 0 where a smaller capacity does as well."""
    worth = np.full(capacity + 1, -np.inf)
    worth[lengths] = values
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        total = worth[1 : c + 1] + best[c - 1 :: -1][:c]
        k = int(total.argmax())
        best[c] = best[c - 1]
        if total[k] > best[c] + 1e-12:
            best[c], pick[c] = total[k], k + 1
    return best, pick


def columns(lengths: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """For each length the best configuration that holds it, as counts of all lengths: the length itself beside the best filling of
    the room it leaves, so one table prices a configuration for every row of the program."""
    capacity = len(pick) - 1
    top = np.maximum.accumulate(np.where(pick > 0, np.arange(capacity + 1), 0))
    place = np.full(capacity + 1, -1)
    place[lengths] = np.arange(len(lengths))
    out = np.eye(len(lengths), dtype=np.int64)
    room = top[capacity - lengths]
    while (live := np.flatnonzero(room > 0)).size:
        last = pick[room[live]]
        out[live, place[last]] += 1
        room[live] = top[room[live] - last]
    return out


@dataclass
class Program:
    """A whole solution of the covering program: copies of configurations that fill a sequence, the pieces these leave, and the copies
    that cover those; with a lower bound on the value of every solution, by the best dual prices met."""

    full: Counter[tuple]
    left: Counter[int]
    others: Counter[tuple]
    bound: float

    @property
    def copies(self) -> list[tuple[tuple, int]]:
        return [*self.full.items(), *self.others.items()]

    @property
    def value(self) -> float:
        return float(self.full.total() + self.others.total())


def _config(lengths: np.ndarray, counts: np.ndarray) -> tuple:
    return tuple((int(lengths[i]), int(counts[i])) for i in np.flatnonzero(counts)[::-1])


def lower_bound(demand: dict[int, int], capacity: int, steps: int = BOUND_STEPS, eta: float = BOUND_ETA) -> float:
    """Sequences that no solution goes below, fractions included: the best dual value met while only the one best configuration of
    each step lowers prices, in full where it uses a demand up. Means of feasible prices are feasible, and steadier; so is a price of
    one for each length over half a sequence, of which no two share one."""
    lengths = np.array(sorted(demand), np.int64)
    n = np.array([demand[x] for x in lengths.tolist()], np.float64)
    prices, mean, bound = lengths / capacity, np.zeros(len(n)), float(n[2 * lengths > capacity].sum())
    for step in range(steps if len(n) else 0):
        best, pick = knapsack(lengths, prices, capacity)
        mean += prices / best[capacity]
        bound = max(bound, float(n @ prices / best[capacity]))
        if step % 8 == 7:
            bound = max(bound, float(n @ mean / knapsack(lengths, mean, capacity)[0][capacity]))
        found = columns(lengths, pick)
        use = found[int((found @ prices).argmax())]
        prices = prices * np.exp(-eta / (1 + step / 10) * use / n * float(np.min(n[use > 0] / use[use > 0])))
    return bound


def priced_steps(left: Counter[int], capacity: int, full: bool, bonus: float = LARGE_FIRST, eta: float = ETA, block: int | None = None) -> tuple[Counter[tuple], Counter[int]]:
    """Multiplicative weights in whole copies: (copies of configurations, pieces left).

    A length's weight starts at its share of the volume and falls by e^-eta as its demand is covered; a covered length leaves. Each
    step prices the lengths, takes `block` of the best configurations by the knapsack (`full`: of those that fill a sequence), and
    of each half the copies that the pieces left allow, rounded to whole ones, until none fits."""
    lengths = np.array(sorted(left), np.int64)
    n = np.array([left[x] for x in lengths.tolist()], np.int64)
    rest, chosen, block = n.copy(), Counter(), block or max(1, len(n) // BLOCK_SHARE)
    while (live := np.flatnonzero(rest > 0)).size:
        size = lengths[live] / capacity
        prices = size * (1 + bonus * size) * np.exp(-eta * (1 - rest[live] / n[live]))
        found = columns(lengths[live], knapsack(lengths[live], prices, capacity)[1])
        if not full:
            found = np.minimum(found, rest[live])
        order = np.argsort(-(found @ prices), kind="stable")
        if full:
            order = order[(found @ lengths[live])[order] == capacity]
        taken = 0
        for row in found[order]:
            own = np.flatnonzero(row)
            most = int((rest[live[own]] // row[own]).min())
            if most:
                most = most if most <= 4 else most // 2
                rest[live[own]] -= most * row[own]
                chosen[_config(lengths[live], row)] += most
                taken += 1
                if taken == block:
                    break
        if not taken:
            break
    return chosen, Counter({x: k for x, k in zip(lengths.tolist(), rest.tolist(), strict=True) if k})


def covering_program(demand: Counter[int], capacity: int) -> Program:
    """Fewest sequences that cover the demand, in whole copies: configurations that fill a sequence first, then any."""
    full, left = priced_steps(demand, capacity, True)
    others, _ = priced_steps(left, capacity, False)  # covers all that is left, as a piece alone is a configuration
    return Program(full, left, others, lower_bound(demand, capacity))


def best_fit(demand: Counter[int], capacity: int) -> Counter[tuple]:
    """Decreasing lengths, each into the fullest open sequence that has room. Sequences of one content are one row with their
    number, of which a length splits one at most, so rows are bounded by the distinct lengths however many pieces there are."""
    rooms: list[tuple[int, int]] = []
    alike: list[tuple[tuple, int]] = []
    done: Counter[tuple] = Counter()

    def put(room: int, config: tuple, copies: int) -> None:
        if room and copies:
            insort(rooms, (room, len(alike)))
            alike.append((config, copies))
        elif copies:
            done[config] += copies

    for x in sorted(demand, reverse=True):
        n = demand[x]
        while n:
            k = bisect_left(rooms, (x, -1))
            room, at = rooms.pop(k) if k < len(rooms) else (capacity, -1)
            times = min(n, room // x)
            config, copies = alike[at] if at >= 0 else ((), n // times)
            used = min(copies, n // times)
            put(room, config, copies - used)
            put(room - times * x, (*config, (x, times)), used)
            n -= times * used
    for _, at in rooms:
        done[alike[at][0]] += alike[at][1]
    return done


@dataclass
class Plan:
    """(configuration, copies) that place every piece exactly once, their number, the program's lower bound on it, and the share of the pieces,
    but for those of a whole sequence, that stand in its full sequences."""

    configurations: list[tuple[tuple, int]]
    value: float
    bound: float
    placed: float


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Pieces as long as a sequence stand alone and stay out of the program. Its full sequences stand; the pieces they leave are covered by
    its other configurations, or by best fit where that takes fewer sequences."""
    left = Counter({x: n for x, n in histogram.items() if n})
    alone = left.pop(capacity, 0)
    solved = covering_program(left, capacity)
    chosen = solved.full + min(solved.others, best_fit(solved.left, capacity), key=Counter.total)
    if alone:
        chosen[((capacity, 1),)] += alone
    placed = 1 - solved.left.total() / max(1, left.total())
    return Plan(sorted(chosen.items(), reverse=True), float(chosen.total()), solved.bound + alone, placed)


def configurations(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple, int]]:
    return plan(histogram, capacity).configurations


def _places(chosen: list[tuple[tuple, int]]) -> tuple[np.ndarray, ...]:
    """Ranges of ranks: from rank `low` among the pieces of a length, `times` to a sequence, from sequence `base` and `offset`."""
    rows, used, base = [], Counter(), 0
    for config, copies in chosen:
        offset = 0
        for x, times in config:
            rows.append((x, used[x], times, base, offset))
            used[x] += copies * times
            offset += x * times
        base += copies
    rows.sort()
    return tuple(np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else [[]] * 5))


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row per piece.

    Null and empty texts are the end id alone; a text longer than a sequence has pieces of `capacity`, the first one shorter
    if need be; repeated rows are packed each; an empty table gives no rows; other columns are ignored."""
    cuts = stage(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    histogram = {r.length: r.n for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    lengths, lows, times, bases, offsets = _places(configurations(histogram, capacity))
    marks = lengths * (1 << 44) + lows
    blocks = max(1, -(-sum(histogram.values()) // BLOCK))
    dealt = cuts.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).cast("int"))
    before = dealt.groupBy("length", "block").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    placed = ranked.join(before.select("length", "block", "before"), ["length", "block"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            k = np.searchsorted(marks, length * (1 << 44) + rank, "right") - 1
            nth = rank - lows[k]
            sequence, offset = bases[k] + nth // times[k], offsets[k] + nth % times[k] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return placed.mapInArrow(run, f"{_PIECES}, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
