import functools
import hashlib
import random
import zlib

from pyspark.sql import functions as F

from dualview.llm import registry, repair
from oracle import assert_same, connect

COLUMNS = "conv_id long, turn long, role string, text string, part int, hash string"


def plain(rows):
    """Every way to edit, tried out: the least (cost, letters, text)."""
    by, out = {}, []
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.rstrip(repair.WHITE)
            faults.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
            seen.add((role, text))

        @functools.cache
        def best(i, last, inserts, own=own, faults=faults):
            """last: initial of what stands before, empty at the start; inserts: how many may still be put in here."""
            role = "assistant" if last == "u" else "user"
            ways = [(0, "", ())] if i == len(own) and last in ("", "a") else []
            if inserts:
                c, s, t = best(i, role[0], inserts - 1)
                ways.append((c + 5, "I" + s, (role + ":", *t)))
            if i < len(own):
                c, s, t = best(i + 1, last, 2)
                ways.append((c + 2, "D" + s, t))
                if faults[i] not in ("b", "d"):
                    more = 5 * (faults[i] == "t")
                    _, kept, text = own[i]
                    if kept[:1] == role[0] or (kept[:1] == "s" and last == ""):
                        c, s, t = best(i + 1, kept[0], 2)
                        ways.append((c + more, "K" + s, (kept + ":" + text, *t)))
                    c, s, t = best(i + 1, role[0], 2)
                    ways.append((c + more + 1, "R" + s, (role + ":" + text, *t)))
            return min(ways, default=(10**9, "", ()))

        cost, audit, lines = best(0, "", 2)
        given = [t for t, _, _ in own if t is not None]
        pairs = zip((r[1][:1] for r in own), (r[1][:1] for r in own[1:]), strict=False)
        out.append((conv, max(given) - min(given) + 1 - len(set(given)) if given else 0, faults.count("b"), faults.count("d"), faults.count("t"), sum(a + b not in ("su", "ua", "au") for a, b in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows], COLUMNS).repartition(3)


def got(df):
    return sorted((tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=str)


def conversations(n, seed=1):
    r = random.Random(seed)
    out = []
    for conv in range(n):
        turn = 0
        for i in range(r.randint(1, 14)):
            turn += r.choice([1, 1, 1, 1, 0, 2, 5])
            role = r.choice(["user", "assistant"]) if r.random() < 0.4 else ["user", "assistant"][i % 2]
            role = r.choice(["system", "tool", "", None, "sys", "Ünit"]) if r.random() < 0.15 else role
            out.append((conv, None if r.random() < 0.07 else turn, role, r.choice(["Yes.", "No!", "so on", "", None, " \n", "Why? \t\n", f"part {i}", f"Done {i}.", "ü漢🙂.", "x" * 3000 + "."])))
    return out


ODD = [(None, 1, "user", "a."), (None, None, "assistant", "b."), (None, None, "assistant", "b."), (900, None, None, None), (901, -(2**62), "user", "a."), (901, 2**61, "assistant", "b."), (902, 1, "system", "a."), (903, 1, "assistant", "a" * 300_000 + "?")]


def test_equals_plain_search(spark):
    rows = conversations(250) + ODD
    assert got(repair.repair(frame(spark, rows))) == plain(rows)
    assert repair.repair(frame(spark, rows).limit(0)).count() == 0
    assert got(repair.repair(frame(spark, ODD[:3]))) == plain(ODD[:3])


def test_conversations_that_span_ranges(spark, monkeypatch):
    monkeypatch.setattr(repair, "RANGE", 7)
    rows = conversations(20, 3) + [(77, t // 3 if t % 5 else None, role, text) for t, (_, _, role, text) in enumerate(conversations(12, 9))] + [(78, 1, "user", "same.")] * 40 + ODD
    assert got(repair.repair(frame(spark, rows))) == plain(rows)


def test_states_stay_few():
    r = random.Random(5)
    a = repair.Automaton()
    for _ in range(2000):
        a.scan([r.randrange(12) for _ in range(r.randint(1, 60))], repair.END)
    assert len(a.vectors) < 200


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in range(5)] + [(None, None, None, None), (7, None, "user", None)]
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (c, t, "user" if k == 4 else role, "" if k == 1 else text.translate({ord(x): None for x in ".!?"}) if k == 2 else text)
        want += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    found = [tuple(r)[:4] for r in repair.damage(frame(spark, rows)).collect()]
    assert sorted(found, key=str) == sorted(want, key=str) and len(set(len(r[3]) for r in found)) > 2


def test_query_equals_sql_with_conversations_that_vanish(spark, tmp_path, small):
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows = conversations(60, 4) + ODD + [(gone, 1, "user", "a.")]
    frame(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    con = connect(small)
    con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    df = registry.op12_repair(spark, str(tmp_path))
    assert_same(df, con, registry.ORACLES["op12_repair"])
    row = df.where(F.col("conv_id") == gone).first()
    assert row["cost"] == 0 and row["audit"] == "" and row["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
