"""Conversation repair against a plain search over all edits, in one chunk and in many."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from quillwork.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, n int, key string, chunk int"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(told):
    seen, out = set(), []
    for role, text in told:
        last = BLANK.findall(text)
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(told):
    """Uniform-cost search over (turns read, roles so far): no use of the four places."""
    found, heap, done = faults(told), [(0, "", 0, ())], set()
    while True:
        cost, audit, n, out = heapq.heappop(heap)
        shape = "".join(r[:1] for r, _ in out)
        if n == len(told) and re.fullmatch("(s?(ua)+)?", shape):
            return cost, audit, out
        if (n, shape[-1:] if shape not in ("", "s") else shape) in done:
            continue
        done.add((n, shape[-1:] if shape not in ("", "s") else shape))
        for role in ("user", "assistant"):
            if re.fullmatch("(s?(ua)*u?)?", shape + role[0]):
                heapq.heappush(heap, (cost + 3, audit + "I", n, (*out, (role, ""))))
        if n < len(told):
            heapq.heappush(heap, (cost + 4, audit + "D", n + 1, out))
            if found[n] not in ("blank", "duplicate"):
                more, (own, text) = 3 * (found[n] == "truncated"), told[n]
                if re.fullmatch("s|(s?(ua)*u?)?", shape + own[:1]) and own[:1]:
                    heapq.heappush(heap, (cost + more, audit + "K", n + 1, (*out, (own, text))))
                for role in ("user", "assistant"):
                    if re.fullmatch("(s?(ua)*u?)?", shape + role[0]):
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", n + 1, (*out, (role, text))))


def expected(rows):
    by, out = {}, {}
    for r in damaged(rows):
        by.setdefault(r[0], []).append(r)
    for conv in {r[0] for r in rows}:
        mine = sorted(by.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        told = [(r[2], r[3]) for r in mine]
        numbers, found = {r[1] for r in mine} - {None}, faults(told)
        cost, audit, repaired = cheapest(told)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:], strict=False))
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out[conv] = (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())
    return out


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", " \n\t", "", None, "Is é so?", "A\nb. \n", f"Turn {rng.random()}.", "x" * 5000])
            rows.append((rng.choice([c, c, c, None]) if c == 3 else c, rng.choice([t, t, t, t + 2, None]), role, text))
    return rows


def run(spark, rows, chunk=turns.CHUNK):
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA)
    found = turns.digest(turns.repair(turns.damage(df), chunk), df).collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: tuple(r)[1:] for r in found}


@pytest.mark.parametrize("seed", range(3))
def test_search(spark, seed):
    rows = random_rows(seed, 40, 9)
    assert run(spark, rows) == expected(rows)


@pytest.mark.parametrize("chunk", [1, 4])
def test_long_conversations_in_chunks(spark, chunk):
    rows = random_rows(7, 6, 40) + random_rows(8, 30, 3)
    assert run(spark, rows, chunk) == expected(rows)


def test_empty_table_and_all_dropped(spark):
    assert run(spark, []) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_query_on_tables_and_sql(spark, data):
    path = f"{data}/conversations.parquet"
    mine = turns.op11_turn_repair(spark, data)
    found = {r.conv_id: tuple(r)[1:] for r in mine.collect()}
    rows = [tuple(r) for r in spark.read.parquet(path).select("conv_id", "turn", "role", "text").collect()]
    assert found == expected(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    other = con.sql(turns.oracle())
    assert other.columns == mine.columns
    assert {r[0]: r[1:] for r in other.fetchall()} == found


def test_sql_on_odd_rows(spark):
    rows = random_rows(11, 30, 8)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert {r[0]: r[1:] for r in con.sql(turns.oracle()).fetchall()} == expected(rows)
