"""The operators on conversations against plain loops."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm import conversation_repair, conversation_trie
from tidemark.llm.common import table

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def plain_trie(rows):
    talks = rebuilt(rows)
    if not talks:
        return []
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        words = len(re.findall("[^\x20\x09-\x0d]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * words
    out = []
    for k, m in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], digest))
    return sorted(out, key=str)


def trie_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def talks(seed, n, longest=6, kinds=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 400), n):
        for turn in range(rng.randint(1, longest)):
            # few texts, so that many conversations share beginnings and some are equal
            rows.append((c, turn, rng.choice(["user", "assistant"]), " ".join(rng.choices(["a", "b c", "d\ne"], k=rng.randint(1, kinds)))))
    return rows


@pytest.mark.parametrize("container", [1, 5, 40, 20_000])
def test_trie_like_a_loop(spark, container):
    rows = talks(1, 120, kinds=1)
    got = conversation_trie.prefix_trie(spark.createDataFrame(rows, TURNS), container)
    assert trie_rows(got) == plain_trie(rows)


def test_trie_hard_cases(spark):
    # null turns, roles, texts and ids; a long conversation; copies of one; ties and repeated rows; turnless ones
    rows = [(40, k, "user", f"w {k}") for k in range(300)] + [(40, 7, "user", "w 7")] * 2
    rows += [(c, k, "user", f"same {k}") for c in range(60, 80) for k in range(12)]
    rows += [(101, None, None, None), (101, None, "user", "x"), (101, 1, "user", ""), (101, 1, "assistant", "y"), (None, 1, "user", "lost"), (203, 0, "user", "z")]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], TURNS + ", words string, depth int")
    for container in (10, 20_000):
        assert trie_rows(conversation_trie.prefix_trie(df, container)) == plain_trie(rows)
    assert any(not t for t in rebuilt(rows).values())


def test_trie_of_an_empty_table(spark):
    assert conversation_trie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_trie_of_the_table(spark):
    df = table(spark, SF, "conversations")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(conversation_trie.prefix_trie(df)) == plain_trie(rows)


# repair


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv]  # noqa: B018
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        out[conv] += [((turn is not None, turn or 0), role, text)] * {0: 0, 3: 2}.get(code, 1)
    return {c: sorted(v) for c, v in out.items()}


def cheapest(rows):
    """(cost, audit, repaired turns) by trying every edit; a state is the text of the initials so far, as far as it matters."""
    known = {}
    ends = re.compile("(s?(ua)+)?").fullmatch
    begins = re.compile("s?(ua)*u?").fullmatch

    def short(initials):  # what can follow depends on little
        pairs = initials.removeprefix("s")
        return initials[: len(initials) - len(pairs)] + ("u" if len(pairs) % 2 else "ua" if pairs else "")

    def best(i, initials, inserted):
        key = (i, initials, inserted)
        if key not in known:
            found = [(0, "", ())] if i == len(rows) and ends(initials) else []

            def go(cost, letter, turn, consumed, insertions):
                new = initials + (turn[0][:1] or "-") if turn else initials
                if begins(new):
                    more, audit, turns = best(i + consumed, short(new), insertions)
                    found.append((cost + more, letter + audit, ((turn,) if turn else ()) + turns))

            if i < len(rows):
                role, text, fault = rows[i]
                go(3, "D", None, 1, 0)
                if fault not in ("blank", "duplicate"):
                    extra = int(fault == "truncated")
                    go(extra, "K", (role, text), 1, 0)
                    for r in ("user", "assistant"):
                        go(2 + extra, "R", (r, text), 1, 0)
            if inserted < 3:
                for r in ("user", "assistant"):
                    go(2, "I", (r, ""), 0, inserted + 1)
            known[key] = min(found, key=lambda f: f[:2], default=(10**9, "", ()))
        return known[key]

    return best(0, "", 0)


def plain_repair(rows):
    out = []
    for conv, turns in damaged(rows).items():
        seen, faulty, counts = set(), [], Counter()
        for _, role, text in turns:
            last = re.findall("[^\x20\x09-\x0d]", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            faulty.append((role, text, fault))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        timed = [t for (known, t), _, _ in turns if known]
        gaps = max(timed) - min(timed) + 1 - len(set(timed)) if timed else 0
        cost, audit, kept = cheapest(faulty)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=str)


def broken_talks(seed, n, longest=12):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["", " \n", None, "ja.", "Done!\t", "open", "why?", f"turn {turn}.", f"turn {turn}", "Ä ß\u2003"])
            rows.append((c, rng.choice([turn, turn, turn, turn * 3, None]), role, text))
    return rows


def test_repair_like_trying_every_edit(spark):
    rows = broken_talks(2, 150) + [(None, 1, "user", "no id."), (None, 2, "assistant", "none")]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], TURNS + ", key string, cost int")
    assert trie_rows(conversation_repair.repair(df)) == plain_repair(rows)


def test_repair_of_spilt_conversations(spark, monkeypatch):
    rows = broken_talks(3, 12, 80)
    monkeypatch.setattr(conversation_repair, "HELD_ROWS", 7)
    monkeypatch.setattr(conversation_repair, "BLOCK", 5)
    # the functions are sent by reference, so they are run here as a task would
    damaged_rows = damaged(rows)
    stream, costs, out = [], conversation_repair.Costs(), []
    for conv, turns in damaged_rows.items():
        seen, now = set(), conversation_repair._Conversation(str(conv))
        marked = []
        for (timed, turn), role, text in turns:
            last = re.findall("[^\x20\x09-\x0d]", text)[-1:]
            marked.append((turn if timed else None, role, text, 1 if not last else 2 if (role, text) in seen else 3 if last[0] not in ".!?" else 0))
            seen.add((role, text))
        for row in reversed(marked):
            now.add(*row, costs, out)
        now.finish(out)
    assert {r[1] for r in out} == {0, 1, 2, 3}
    stream = conversation_repair._frame(sorted((r for r in out if r[1]), key=lambda r: (r[0], -r[2], r[1])))
    done = [(int(r[0]), *r[3:11]) for r in out if r[1] == 0]
    for a in (1, 11, 10_000):  # batches of any size
        batches = (stream[k : k + a] for k in range(0, len(stream), a))
        spilt = [(int(r[0]), *r[1:]) for f in conversation_repair._forward(batches) for r in f.itertuples(index=False)]
        assert sorted(done + spilt, key=str) == plain_repair(rows)


def test_repair_of_a_long_conversation(spark):
    rows = [(7, k, ["user", "assistant"][k % 2], f"turn {k}." if k % 5 else "cut") for k in range(6_000)]
    got = conversation_repair.repair(spark.createDataFrame(rows, TURNS))
    import sys

    sys.setrecursionlimit(50_000)
    assert trie_rows(got) == plain_repair(rows)


def test_repair_of_an_empty_table_and_lost_rows(spark):
    assert conversation_repair.repair(spark.createDataFrame([], TURNS)).collect() == []
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = trie_rows(conversation_repair.repair(spark.createDataFrame([(lost, 0, "user", "gone.")], TURNS)))
    assert got == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_repair_of_the_table(spark):
    df = table(spark, SF, "conversations")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(conversation_repair.repair(df)) == plain_repair(rows)
