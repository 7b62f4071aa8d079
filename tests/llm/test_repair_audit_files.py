"""Token files, conversation repair and the filter audit against plain code."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumenframe.llm import conversation_repair as cr
from lumenframe.llm import filter_audit as fa
from lumenframe.llm import token_files as tf
from lumenframe.llm.queries import tokenizer_path

TURNS = "conv_id long, turn long, role string, text string, place int, first int, code int, `table` int"


def pad(rows):
    return [(*r, 1, 2, 3, 4) for r in rows]


# ---- token files


def library_ids(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for x in texts]


def test_token_files(spark, odd, odd_rows, tmp_path):
    folder = str(tmp_path / "tokens")
    manifest = tf.write_tokens(odd, folder, tokenizer_path()).collect()
    got = sorted((tuple(r) for r in tf.read_documents(spark, folder).collect()), key=lambda r: r[1])
    ids = library_ids([r[1] for r in odd_rows], 1)
    assert Counter((d, n, c) for d, _, n, c in got) == Counter((r[0], len(x), zlib.crc32(x.tobytes())) for r, x in zip(odd_rows, ids, strict=True))
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist()
    names = [r[0] for r in got]
    assert names == sorted((d for d in names if d is not None)) + [None] * 3
    assert sum(r["docs"] for r in manifest) == len(odd_rows) and {r["width"] for r in manifest} == {2}
    files = tf.TokenFiles(folder)
    every = np.concatenate([files.document(i) for i in range(len(got))])
    assert files.tokens == len(every) and [zlib.crc32(files.document(i).astype("<u4").tobytes()) for i in range(len(got))] == [r[3] for r in got]
    for start, n in ((0, 10), (len(every) // 3, 5000), (len(every) - 3, 50), (len(every), 5)):
        assert files.window(start, n).tolist() == every[start : start + n].tolist()
    with pytest.raises(IndexError):
        files.document(len(got))
    assert not [p for p in (tmp_path / "tokens").iterdir() if p.name.count(".") > 1 and not p.name.startswith(".")]


def test_token_files_of_nothing(spark, none, tmp_path):
    assert tf.write_tokens(none, str(tmp_path / "none"), tokenizer_path()).count() == 0
    assert tf.read_documents(spark, str(tmp_path / "none")).count() == 0
    assert tf.TokenFiles(str(tmp_path / "none")).window(0, 4).tolist() == []


# ---- conversations


def damaged(rows):
    out, ids = defaultdict(list), set()
    for c, t, r, x in rows:
        ids.add(c)
        key, r, x = ":".join(" " if v is None else str(v) for v in (c, t)), " " if r is None else r, " " if x is None else x
        k = zlib.crc32(key.encode()) % 20
        if k:
            out[c] += [(t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)] * (2 if k == 3 else 1)
    return {c: out[c] for c in ids}


def cheapest(rows, faults):
    """Uniform-cost search over (cost, letters): independent of distances to the end."""
    lead = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    forced = [(2, "user"), (2, "user"), (3, "assistant"), (2, "user")]
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, letters, i, q, out = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(rows) and q in (0, 3):
            return cost, letters, out
        p, role = forced[q]
        heapq.heappush(heap, (cost + 2, letters + "I", i, p, (*out, f"{role}:")))
        if i < len(rows):
            (_, r, x), extra = rows[i], faults[i] == "cut"
            heapq.heappush(heap, (cost + 3, letters + "D", i + 1, q, out))
            if faults[i] in ("", "cut"):
                heapq.heappush(heap, (cost + 2 + extra, letters + "R", i + 1, p, (*out, f"{role}:{x}")))
                if (q, r[:1]) in lead:
                    heapq.heappush(heap, (cost + extra, letters + "K", i + 1, lead[q, r[:1]], (*out, f"{r}:{x}")))


def brute_repair(rows):
    out = {}
    for c, own in damaged(rows).items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, r, x in own:
            core = re.sub(r"[\x20\x09-\x0D]", "", x)
            faults.append("blank" if not core else "copy" if (r, x) in seen else "cut" if core[-1] not in ".!?" else "")
            seen.add((r, x))
        turns = {t for t, _, _ in own if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, letters, text = cheapest(own, faults)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[c] = (gaps, faults.count("blank"), faults.count("copy"), faults.count("cut"), illegal, cost, letters, hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


def turns_of(seed, conversations=60, most=14):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "so it goes", "", None, " \n", "Why?  ", "one. two", "é漢.", "ends in nbsp. ", "Yes."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "users"]
    rows = []
    for c in range(conversations):
        role = rng.randrange(2)
        for t in range(rng.randrange(most)):
            plain = rng.random() < 0.7
            rows.append((c, t if rng.random() < 0.9 else rng.choice([None, 0, t + 3]), ("user", "assistant")[(t + role) % 2] if plain else rng.choice(roles), f"Turn {t} of {c}." if plain else rng.choice(texts)))
    rows += [(None, 0, "user", "Hm."), (None, None, None, None), (10**12, None, None, "x" * 100_000 + ".")]
    rows += [(7000, t, "user", "The same.") for t in range(120)] + [(7001, 5, "user", "Ties."), (7001, 5, "assistant", "Ties."), (7001, 5, "user", "Ties!")]
    rows += [(7002, 1, "user", "Equal rows.")] * 40
    return rows


@pytest.mark.parametrize(("seed", "segment"), [(1, cr.SEGMENT), (2, 3), (3, 1)])
def test_repair(spark, seed, segment):
    rows = turns_of(seed)
    got = cr.conversation_repair(spark.createDataFrame(pad(rows), TURNS).repartition(3), segment).collect()
    want = brute_repair(rows)
    assert len(got) == len(want)
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want


def test_repair_of_nothing(spark):
    assert cr.conversation_repair(spark.createDataFrame([], TURNS)).count() == 0
    gone = [(c, 0, "user", "Hm.") for c in range(300) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = cr.conversation_repair(spark.createDataFrame(pad(gone), TURNS)).collect()
    assert len(got) == len(gone) > 5 and {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_distances_agree_with_a_plain_search():
    rng = np.random.default_rng(4)
    for n in (1, 2, 9):
        codes = rng.integers(0, 16, n)
        dist, level = cr.distances(codes, np.array([0, n]))
        for q, e in itertools.product(range(4), range(4)):
            best = {(0, q): 0}
            for i in range(n):
                for _ in range(4):  # insertions, which may follow each other
                    for p in range(4):
                        if (i, p) in best:
                            t = (i, int(cr.FORCED[p]))
                            best[t] = min(best.get(t, 10**6), best[i, p] + 2)
                for p, t in itertools.product(range(4), range(4)):
                    if (i, p) in best and cr._ROW[codes[i], p, t] < cr.FAR:
                        best[i + 1, t] = min(best.get((i + 1, t), 10**6), best[i, p] + int(cr._ROW[codes[i], p, t]))
            assert dist[e, level[0], q] == best.get((n, e), cr.FAR)


# ---- filters


def brute_audit(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    rows, texts = [], defaultdict(list)
    for d, t, lang, *_ in docs:
        texts[t or ""].append(d)
    for d, t, lang, *_ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        ids = [x for x in texts[t] if x is not None]
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": bool(ids) and (d is None or d > min(ids)),
        }
        rows.append((lang or "", {f for f, v in fails.items() if v}, d is not None and d in good, d is not None and d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                kept = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                out[part, "".join(order), k + 1] = [len(kept), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                left = kept
        for (p, order, k), v in out.items():
            if p == part:
                v.append(total[order[k - 1]])
    return out


def test_audit(spark, odd, odd_rows):
    marks = [(i, i % 2, i % 3, 1) for i in range(0, 40, 2)] + [(2, None, 1, 1), (2, 1, None, 1), (None, 1, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int, part int")
    extra = [(900 + i, t, "fr", "s", 1, *odd_rows[0][5:]) for i, t in enumerate(["A B C " * 100, "w " * 300, "plain $ words " * 90, " ".join(map(str, range(300))), "UP " + " ".join(map(str, range(250)))] * 2)]
    rows = [*odd_rows, *extra]
    got = fa.filter_audit(spark.createDataFrame(rows, odd.schema).repartition(3), labels).collect()
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got} == brute_audit(rows, [m[:3] for m in marks])
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_audit_of_nothing(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.filter_audit(none, labels).count() == 0


def test_audit_takes_other_filters(spark):
    rows = spark.createDataFrame([("p", True, False, i) for i in range(12)] + [("q", False, True, None)], "part string, good boolean, toxic boolean, n int")
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["shapley"]) for r in fa.audit(rows, {"X": "n % 2 = 0", "Y": "n % 3 = 0"}).collect()}
    assert got["p", "XY", 1] == (6, 6, 10) and got["p", "XY", 2] == (4, 2, 6) and got["p", "YX", 1] == (8, 4, 6) and got["p", "YX", 2] == (4, 4, 10)
    assert got["q", "XY", 2] == (1, 0, 0)
