"""Repair of conversations against a plain search over all edits, with blocks of a few rows and of many."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cuelattice.llm import conversations as c
from cuelattice.llm import registry

KIND = "conv_id long, turn long, role string, text string, at long, id long, key string, edit string"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def plain(rows):
    """Faults, cost, audit and repaired lines of one conversation: the best of all ways from the last row to the first."""
    rows = sorted(((t is not None, t or 0, r or "", x or "") for t, r, x in rows))
    seen, told = set(), []
    for _, _, role, text in rows:
        last = text.rstrip(SPACE)[-1:]
        told.append((role, text, not last, (role, text) in seen, last not in ("", ".", "!", "?")))
        seen.add((role, text))
    follows = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}
    after = {s: (0, "", ()) if s in ("", "a") else None for s in follows}

    def least(ways):
        return min((w for w in ways if w), key=lambda w: (w[0], w[1]), default=None)

    def more(cost, letter, line, rest):
        return rest and (cost + rest[0], letter + rest[1], (line, *rest[2]) if line else rest[2])

    def inserted(best):
        for _ in range(3):
            best = {s: least([best[s], more(5, "I", full[follows[s]] + ":", best[follows[s]])]) for s in follows}
        return best

    after = inserted(after)
    for role, text, blank, again, cut in reversed(told):
        here = {}
        for s in follows:
            ways = [more(2, "D", None, after[s])]
            if not blank and not again:
                q, extra = role[:1], 5 * cut
                if q in ("s", "u", "a") and (q == follows[s] or q == "s" and s == ""):
                    ways.append(more(extra, "K", f"{role}:{text}", after[q]))
                ways.append(more(1 + extra, "R", f"{full[follows[s]]}:{text}", after[follows[s]]))
            here[s] = least(ways)
        after = inserted(here)
    turns = [t for known, t, _, _ in rows if known]
    first = [[b, a, k] for _, _, b, a, k in told]
    pairs = [(x[0][:1], y[0][:1]) for x, y in zip(told, told[1:])]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        "blank": sum(b for b, _, _ in first),
        "duplicate": sum(a and not b for b, a, _ in first),
        "truncated": sum(k and not a and not b for b, a, k in first),
        "illegal": sum("".join(p) not in ("su", "ua", "au") for p in pairs),
        "cost": after[""][0],
        "audit": after[""][1],
        "repaired_sha256": hashlib.sha256("\n".join(after[""][2]).encode()).hexdigest(),
    }


def solved(turns, block):
    rows = c.rows_in_order(turns)
    blocks = c.blocks_of(rows, block)
    found = c.repair(rows, blocks).cache()
    out = {}
    for r in c.counts(found).collect():
        out[r.id] = r.asDict()
    for r in c.illegal_pairs(blocks).collect():
        out[r.id]["illegal"] = r.illegal + out[r.id].pop("further")
    for r in c.digests(c.repaired_turns(turns, found)).collect():
        out[r.id] |= r.asDict()
    return out


@pytest.fixture(scope="module")
def talks():
    rng, rows = random.Random(5), []
    says = ["Yes.", "No", "Why?", "", " \n", "Go!", "Well. ", "é", "None."]
    for conv in range(150):
        for turn in range(rng.randrange(1, 12)):
            rows.append((conv, rng.choice([turn, turn, turn, None, turn // 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "", "Tool"]), rng.choice([*says, f"Line {turn}.", f"Line {turn}"])))
    rows += [(None, t, r, f"Said {t}.") for t, r in enumerate(["assistant", "user", "user"])]
    rows += [(9000, t, rng.choice(["user", "assistant"]), f"Long {t}{rng.choice(['.', '?', ''])}") for t in range(700)]
    rows += [(9001, 1, "user", "Again and again.")] * 60
    return rows


@pytest.mark.parametrize("block", [2, 7, 4096])
def test_against_plain_search(spark, talks, block):
    got = solved(spark.createDataFrame([(*r, 0, 1, "k", "e") for r in talks], KIND), block)
    by = {}
    for conv, *row in talks:
        by.setdefault(conv, []).append(row)
    assert set(got) == set(by)
    for conv, rows in by.items():
        want = plain(rows)
        assert {k: got[conv][k] for k in want} == want, (conv, rows)


def test_long_texts_and_empty_tables(spark):
    assert solved(spark.createDataFrame([], KIND), 4096) == {}
    long = "word " * 300_000
    got = solved(spark.createDataFrame([(1, 1, "user", long, 0, 0, "", ""), (1, 2, "assistant", long + ".", 0, 0, "", "")], KIND), 4096)
    assert got[1]["audit"] == "DD" and got[1]["cost"] == 4 and got[1]["truncated"] == 1


def test_damage_and_conversations_that_lose_all_rows(spark, tmp_path):
    import zlib

    rows = [(i, t, "user", f"Hi {i}.") for i in range(40) for t in [0]] + [(None, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in registry.op11_conversation_repair(spark, str(tmp_path)).collect()}
    gone = {i for i in range(40) if zlib.crc32(f"{i}:0".encode()) % 20 == 0}
    assert set(got) == {*range(40), None} and gone
    assert all((got[i].audit, got[i].cost, got[i].repaired_sha256) == ("", 0, hashlib.sha256(b"").hexdigest()) for i in gone)
    fault = zlib.crc32(b" : ") % 20
    assert (got[None].blank, got[None].audit) == ((0, "") if fault == 0 else (2, "DD") if fault == 3 else (1, "D"))
    emptied = [i for i in range(40) if zlib.crc32(f"{i}:0".encode()) % 20 == 1]
    assert all(re.fullmatch("D", got[i].audit) and got[i].blank == 1 for i in emptied)
    assert got[min(set(range(40)) - gone)].gaps == 0


def test_plan_sorts_no_texts(spark, sf_dir):
    rows = c.rows_in_order(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    assert "text" not in rows.columns and rows.where(F.col("copies") < 1).count() == 0
