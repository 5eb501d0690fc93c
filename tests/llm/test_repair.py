"""Conversation repair against every edit sequence, and the query against a
plain version of its contract."""

import hashlib
import itertools
import random
import re
import zlib

import pandas as pd
import pytest

from clickspark.llm import repair as R

PATTERN = re.compile(r"(s?(ua)+)?\Z")


def brute(codes):
    """Least (cost, audit) over all edit sequences with few insertions."""
    best = None
    choices = []
    for c in codes:
        o = [("D", 2, "")]
        if not c & R.MUST_GO:
            stay = 5 if c & R.STOPS_SHORT else 0
            o += [("K", stay, "suax"[c & 3]), ("R", 1 + stay, "u"), ("R", 1 + stay, "a")]
        choices.append(o)
    gaps = [("", ""), ("I", "u"), ("I", "a"), ("II", "ua"), ("II", "au")]
    for edits in itertools.product(*choices):
        for ins in itertools.product(gaps, repeat=len(codes) + 1):
            if sum(len(g[0]) for g in ins) > 2:
                continue
            letters, roles, cost = ins[0][0], ins[0][1], 5 * sum(len(g[0]) for g in ins)
            for e, g in zip(edits, ins[1:]):
                letters, roles, cost = letters + e[0] + g[0], roles + e[2] + g[1], cost + e[1]
            if PATTERN.match(roles) and (best is None or (cost, letters) < best):
                best = (cost, letters)
    return best


def test_search_is_optimal():
    rng = random.Random(5)
    for _ in range(250):
        codes = bytes(rng.choice((0, 1, 2, 3)) | rng.choice((0, 0, 0, 4, 8)) for _ in range(rng.randint(0, 4)))
        assert R.search(codes) == brute(codes), codes


def test_any_lower_bound_gives_the_same(monkeypatch):
    """The search does not lean on the bound being tight."""
    rng = random.Random(6)
    cases = [bytes(rng.choice((0, 1, 1, 2, 2, 3)) | rng.choice((0, 0, 0, 4, 8)) for _ in range(rng.randint(0, 12)))
             for _ in range(80)]
    tight = [R.search(c) for c in cases]
    real = R.suffix_bounds
    monkeypatch.setattr(R, "suffix_bounds", lambda codes, ends: [
        [b if b >= R._INF else max(0, b - 7 - 3 * (i % 2)) for b in row] for i, row in enumerate(real(codes, ends))])
    assert [R.search(c) for c in cases] == tight


def test_stretches_chain_to_the_whole():
    rng = random.Random(7)
    for _ in range(60):
        codes = bytes(rng.choice((0, 1, 1, 2, 2, 3)) | rng.choice((0, 0, 4, 8)) for _ in range(rng.randint(1, 40)))
        cuts = sorted({0, len(codes), *(rng.randint(0, len(codes)) for _ in range(3))})
        parts = [codes[a:b] for a, b in itertools.pairwise(cuts)]
        links = [{(a, b): x for a in range(4) for b in range(4) if (x := R.search(p, a, (b,))) is not None} for p in parts]
        assert R.chained(links) == R.search(codes)


def plain(rows):
    """The contract, one conversation at a time, on pandas rows; the audit from
    one forward pass over all states."""
    out = []
    space = " \t\n\x0b\x0c\r"
    none = lambda x: x is None or x != x
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(None if none(c) else int(c), []).append((None if none(t) else int(t), r, x))
    for conv, given in groups.items():
        turns = []
        for t, r, x in given:
            r, x = " " if none(r) else r, " " if none(x) else x
            hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if t is None else t}".encode()) % 20
            if hit == 0:
                continue
            x = "" if hit == 1 else re.sub(r"[.!?]", "", x) if hit == 2 else x
            turns += [(t, "user" if hit == 4 else r, x)] * (2 if hit == 3 else 1)
        digest = lambda r, x: hashlib.sha256(
            f"{'' if conv is None else conv}:{len(r)}:{r}{x}".encode()).digest()[:16]
        turns.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), digest(*v[1:])))
        count, seen, best = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), {"": (0, "", ())}
        step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

        def grow(best):
            for _ in range(4):
                for s, (c, a, o) in list(best.items()):
                    for r in ("u", "a"):
                        if r in step[s]:
                            new = (c + 5, a + "I", (*o, ("user" if r == "u" else "assistant") + ":"))
                            if r not in best or new < best[r]:
                                best[r] = new
            return best

        for t, r, x in turns:
            fault = "blank" if not x.strip(space) else "duplicate" if (r, x) in seen else \
                "truncated" if x.strip(space)[-1] not in ".!?" else None
            seen.add((r, x))
            if fault:
                count[fault] += 1
            now = {}
            for s, (c, a, o) in grow(best).items():
                tries = [(s, (c + 2, a + "D", o))]
                if fault not in ("blank", "duplicate"):
                    stay = 5 if fault else 0
                    if r[:1] in step[s]:
                        tries.append((r[:1], (c + stay, a + "K", (*o, f"{r}:{x}"))))
                    tries += [(v[0], (c + 1 + stay, a + "R", (*o, f"{v}:{x}"))) for v in ("user", "assistant") if v[0] in step[s]]
                for to, new in tries:
                    if to not in now or new < now[to]:
                        now[to] = new
            best = now
        cost, audit, lines = min(v for s, v in grow(best).items() if s in ("", "a"))
        numbers = [t for t, _, _ in turns if t is not None]
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        out.append((conv, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, count["blank"],
                    count["duplicate"], count["truncated"], illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def same(df, rows):
    key = lambda v: (v[0] is not None, v[0] or 0)
    got = sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=key)
    assert got == sorted(plain(rows), key=key)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query(spark, size):
    sf = f"/root/testdata/{size}"
    rows = pd.read_parquet(f"{sf}/conversations.parquet")
    same(R.query(spark, sf), rows[["conv_id", "turn", "role", "text"]].itertuples(index=False))


def rows_by_hand():
    rng = random.Random(8)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No", None, "", " \n", "Why? ", "é!", "x" * 50000]
    rows = [(c, rng.choice([None, *range(-2, 9)]), rng.choice(roles), rng.choice(texts))
            for c in (None, -5, 0, 1, 2, 3) for _ in range(12)]
    rows += [(9, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}." if i % 7 else "twice") for i in range(400)]
    return rows + [(10, 1, "user", "Same.")] * 50 + [(11, 3, "user", "only")]


@pytest.mark.parametrize("stretch", [4096, 17])
def test_nulls_ties_copies_and_borders(spark, tmp_path, monkeypatch, stretch):
    monkeypatch.setattr(R, "STRETCH", stretch)
    rows = rows_by_hand()
    df = spark.createDataFrame([(*r, 1, "z") for r in rows],
                               "conv_id long, turn long, role string, text string, code int, digest string")
    df.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    same(R.query(spark, str(tmp_path)), rows)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    out = R.query(spark, str(tmp_path))
    assert out.columns == NAMES and out.count() == 0


def test_repaired_turns_alternate(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi!"), (1, 2, "user", "Hi!"),
                                (1, 3, "tool", "Done.")], "conv_id long, turn long, role string, text string")
    audits = R.repairs(df)
    assert audits.first()["audit"] == "DKDR"
    got = R.repaired(df, audits).orderBy("position").collect()
    assert [(r["role"], r["text"]) for r in got] == [("user", "Hi!"), ("assistant", "Done.")]
