import posixpath
import random
from collections import Counter, defaultdict

import pytest
import xxhash

from quarrykit.llm import p3_split as p3
from quarrykit.llm import p4_splits as p4
from quarrykit.llm import p5_overlap as p5
from quarrykit.runtime import read_table


@pytest.mark.parametrize("size, overlap", [(1 << 12, 200), (1 << 18, 200), (1 << 12, 0)])
def test_pieces_round_trip(spark, size, overlap):
    rng = random.Random(3)
    big = "".join(rng.choice(["def f(x):\n", "    return é中🚚\n", "word ", ". ", "x" * 50, "\n\n", "a" * 3000]) for _ in range(300))
    rows = [("t", 1, big, "c"), ("t", 2, "y" * 2001, "c"), ("t", 2, "y" * 2001, "c"), ("t", 3, "z" * 2000, "c"), ("t", 4, None, "c"), ("t", 5, "", "c"), ("u", 1, "🚚" * 9001, "c")]
    items = spark.createDataFrame(rows, "item_kind string, item_no bigint, text string, piece string")
    src = {(k, n): t for k, n, t, _ in rows}
    got = defaultdict(list)
    for r in p3.pieces(items, overlap=overlap, size=size).orderBy("item_kind", "item_no", "piece_no").collect():
        got[r["item_kind"], r["item_no"]].append(r)
    assert set(got) == {("t", 1), ("t", 2), ("u", 1)}
    for key, ps in got.items():
        assert "".join(p["piece"][p["overlap"] :] for p in ps) == src[key]
        assert max(len(p["piece"]) for p in ps) <= 2000 and [p["piece_no"] for p in ps] == list(range(len(ps)))
        assert [p["overlap"] for p in ps] == [0] + [overlap] * (len(ps) - 1)
        assert all(a["char_end"] == b["char_start"] for a, b in zip(ps, ps[1:])) and ps[-1]["char_end"] == len(src[key])
        assert all(not o["overlap"] or a["piece"].endswith(o["piece"][: o["overlap"]]) for a, o in zip(ps, ps[1:]))


@pytest.mark.parametrize("size", [1 << 12, 1 << 18])
def test_files_are_read_by_ranges(spark, tmp_path, size, monkeypatch):
    """Files come out as their texts do, and no read is longer than a range with its halos."""
    rng = random.Random(4)
    texts = {n: "".join(rng.choice(["def f(x):\n", "    return é中🚚\n", "word ", "\n\n", "a" * 300]) for _ in range(n)) for n in (3, 400, 2500)}
    for n, t in texts.items():
        (tmp_path / f"f{n}.txt").write_bytes(t.encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "skip.bin").write_bytes(b"x" * 9000)
    got = defaultdict(list)
    for r in p3.file_pieces(spark, str(tmp_path), "*.txt", size=size).orderBy("item_path", "piece_no").collect():
        got[r["item_path"].rsplit("/", 1)[-1]].append(r)
    assert set(got) == {f"f{n}.txt" for n, t in texts.items() if len(t.encode()) > 2000}
    for name, ps in got.items():
        t = texts[int(name[1:-4])]
        assert "".join(p["piece"][p["overlap"] :] for p in ps) == t and [p["piece_no"] for p in ps] == list(range(len(ps))) and max(len(p["piece"]) for p in ps) <= 2000
        assert all(t.encode()[p["byte_start"] : p["byte_end"]].decode() == p["piece"][p["overlap"] :] for p in ps)
    assert p3.file_pieces(spark, str(tmp_path), "*.none").count() == 0


def test_pieces_cut_at_boundaries():
    text = ("x = 1\n" * 100 + "\n\ndef f():\n    pass\n") * 4
    ends = p3.cuts(text, 1000)
    assert all(kind in ("definition", "end") for _, kind in ends)


def test_pieces_bad_overlap(spark):
    with pytest.raises(ValueError):
        p3.pieces(spark.createDataFrame([], "item_kind string, item_no bigint, text string"), limit=100, overlap=100)


PAIRS = "pair_no bigint, split_name string, repo string, target_id string, context_id string, description string, code string, label int, text string, group_no int"


def brute_groups(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for r in rows:
        find(("pair", r[0]))
        for i in (3, 4):
            if r[i] and "@" in r[i]:
                path = posixpath.normpath(r[i].split("@")[-1].strip().replace("\\", "/")).lstrip("/")
                a, b = find(("pair", r[0])), find((r[2] or "", path))
                parent[a] = b
    groups = defaultdict(list)
    for r in {r[0]: r for r in rows}.values():
        groups[find(("pair", r[0]))].append(r[0])
    return {x: min(g) for g in groups.values() for x in g}


def test_groups_and_splits(spark):
    rng = random.Random(5)
    spell = [lambda p: p, lambda p: "./" + p, lambda p: p.replace("/", "//"), lambda p: p.replace("/", "\\"), lambda p: "q/../" + p, lambda p: p + " "]
    rows = []
    for n in range(1, 900):
        repo = rng.choice(["a", "a", "b", None])
        block = rng.randrange(40) if rng.random() < 0.7 else 99  # one hot file
        rows.append((n, "train", repo, f"f@{rng.choice(spell)(f's/m{block}.py')}", f"g@{rng.choice(spell)(f's/c{block}_{rng.randrange(3)}.py')}", "d", "c", rng.choice([0, 1, None]), "", 7))
    rows += rows[:9] + [(2000, "test", "a", None, None, None, None, None, None, 7), (2001, "test", "a", "nopath", "nopath", None, None, 1, None, 7)]
    df = spark.createDataFrame(rows, PAIRS)
    got = {r["pair_no"]: r["group_no"] for r in p4.grouped(df).collect()}
    assert got == brute_groups(rows)
    dealt = p4.assign(p4.grouped(df), df.select("pair_no", "label")).collect()
    assert len(dealt) == len(got) and {r["split"] for r in dealt} <= {"train", "valid", "test"}
    per = defaultdict(set)
    for r in dealt:
        per[r["group_no"]].add(r["split"])
    assert all(len(s) == 1 for s in per.values())
    assert p4.grouped(df.limit(0)).count() == 0


def test_dealing_is_exact_in_large_bundles(spark, monkeypatch):
    """Each label value, null too, meets the shares to a row, and large bundles are dealt just as small ones."""
    rows = [(n, n, (None, 0, 1)[n % 3]) for n in range(1500)]
    df = spark.createDataFrame(rows, "pair_no bigint, group_no bigint, label int")
    got = {}
    for few in (4096, 100):
        monkeypatch.setattr(p4, "FEW", few)
        got[few] = {r["pair_no"]: r["split"] for r in p4.assign(df.select("pair_no", "group_no"), df.select("pair_no", "label")).collect()}
    count = Counter((n % 3, split) for n, split in got[100].items())
    assert got[100] == got[4096] and count == {(k, s): n for k in range(3) for s, n in (("train", 400), ("valid", 50), ("test", 50))}


def test_allocation_meets_quotas():
    bundles = [(c, size, n, size * n) for c in range(3) for size, n in ((1, 400), (3, 120), (10, 30))]
    got = p4.allocate(bundles)
    total = sum(b[3] for b in bundles)
    for s, (_, share) in enumerate(p4.SHARES):
        assert abs(sum(g[s] * b[1] for g, b in zip(got, bundles)) - share * total) <= 12
    assert all(sum(g) == b[2] for g, b in zip(got, bundles))


def test_allocation_around_a_giant():
    for order in (1, -1):
        bundles = [(2, 1200, 1, 1200), (2, 36, 1, 36), (1, 32, 1, 32), (2, 9, 300, 2700), (1, 8, 500, 4000), (0, 1, 900, 900)][::order]
        got = p4.allocate(bundles)
        total = sum(b[3] for b in bundles)
        assert all(x >= 0 for g in got for x in g) and all(sum(g) == b[2] for g, b in zip(got, bundles))
        for s, (_, share) in enumerate(p4.SHARES):
            held = sum(g[s] * b[1] for g, b in zip(got, bundles))
            assert abs(held - share * total) <= max(12, 1200 - share * total if any(g[s] and b[1] == 1200 for g, b in zip(got, bundles)) else 12)


def test_labels_are_balanced():
    """Bundles whose labels differ within one profile class: shares of labels come out alike, and no giant makes a small split."""
    rng = random.Random(2)
    bundles, labels = [(2, 900, 1, 900)], [(400.0, 3.0)]
    for _ in range(60):
        size, n = rng.randrange(1, 40), rng.randrange(1, 30)
        bundles.append((2, size, n, size * n))
        labels.append((float(rng.randrange(size + 1)), 0.0))
    got = p4.allocate(bundles, labels=labels)
    total, positive = sum(b[3] for b in bundles), sum(b[2] * p for b, (p, _) in zip(bundles, labels))
    assert got[0] == [1, 0, 0] and all(sum(g) == b[2] for g, b in zip(got, bundles))
    for s, (_, share) in enumerate(p4.SHARES):
        held = sum(g[s] * b[1] for g, b in zip(got, bundles))
        with_label = sum(g[s] * p for g, (p, _) in zip(got, labels))
        assert abs(held - share * total) <= 12 and abs(with_label - share * positive) <= 12


def test_min_cost_flow():
    # two ways of cost 1 and 3, capacity 2 and 5
    assert p4.min_cost_flow(4, [(0, 1, 2, 1), (0, 2, 5, 3), (1, 3, 9, 0), (2, 3, 4, 0)], 0, 3) == [2, 4, 2, 4]


DESC = "When a sprite turns out to be malformed the decoder falls back to the cached voucher and logs the broker for the next {} runs."
CODE = "def load(path, limit):\n    total = fetch_rows('{0}', {1})\n    for row in path.rows:\n        total.append(row.merge('{0} key', {1}))\n    return total.finish('{0}')"


def test_overlaps(spark):
    rows = [
        (1, "train", "a", None, None, DESC.format(5), CODE.format("east", 17), 1, "", 0),
        (2, "test", "b", None, None, DESC.format(5).upper().replace(" ", "  "), CODE.format("east", 17).replace("total", "acc").replace("'", '"') + "  # done", 0, "", 0),
        (3, "valid", "b", None, None, DESC.format(6), CODE.format("east", 17), None, "", 0),
        (4, "test", "b", None, None, DESC.format(5), CODE.format("west", 99).replace("fetch_rows", "other_call").replace("merge", "drop").replace("finish", "close").replace("append", "push"), 1, "", 0),
        (5, "test", "b", None, None, "Something wholly different about tables and lists of users in the shop.", CODE.format("east", 17), 1, "", 0),
        (6, "test", "b", None, None, None, CODE.format("east", 17), 1, "", 0), (7, "train", "b", None, None, "DOCSTRING", "x = 1", 1, "", 0), (8, "test", "b", None, None, "DOCSTRING", "x = 1", 1, "", 0),
        (9, "train", "b", None, None, DESC.format(5), None, 1, "", 0), (10, "train", "a", None, None, DESC.format(5), CODE.format("east", 17), 1, "", 0), (10, "train", "a", None, None, DESC.format(5), CODE.format("east", 17), 1, "", 0),
        (11, None, "a", None, None, DESC.format(5), CODE.format("east", 17), 1, "", 0), (12, "test", "a", None, None, "word " * 40000, "y = 2\n" * 30000, 1, "", 0),
    ]
    got = {(r["eval_no"], r["train_no"]) for r in p5.overlaps(spark.createDataFrame(rows, PAIRS)).collect()}
    assert got == {(2, 1), (2, 10), (3, 1), (3, 10)}
    assert p5.overlaps(spark.createDataFrame([], PAIRS)).count() == 0


def test_overlaps_against_brute_force(spark, sf):
    pairs = read_table(spark, sf, "training_pair")
    got = {(r["eval_no"], r["train_no"]) for r in p5.overlaps(pairs).collect()}
    rows = {r["pair_no"]: r for r in pairs.collect()}
    d = {k: p5.description_words(r["description"]) for k, r in rows.items()}
    c = {k: p5.code_words(r["code"]) for k, r in rows.items()}
    count = {k: Counter(v) for k, v in d.items()}
    want = set()
    for e, r in rows.items():
        if r["split_name"] == "train" or not d[e] or not c[e]:
            continue
        for t, s in rows.items():
            if s["split_name"] == "train" and d[t] and c[t] and (count[e] & count[t]).total() >= 0.4 * max(len(d[e]), len(d[t])):
                if p5.near_same(d[e], d[t], "description") and p5.near_same(c[e], c[t], "code"):
                    want.add((e, t))
    assert got == want


@pytest.mark.parametrize("hot", [4096, 0])
def test_overlaps_of_short_edits(spark, monkeypatch, hot):
    """Whatever the exact check accepts is found: words replaced, dropped and put in, in short descriptions and in code."""
    monkeypatch.setattr(p5, "HOT", hot)
    rng = random.Random(8)
    voc = [f"w{i}" for i in range(400)]

    def edit(words, times):
        words = list(words)
        for _ in range(times):
            at, how = rng.randrange(len(words)), rng.random()
            words[at : at + (how < 0.8)] = [rng.choice(voc)] if how > 0.2 else []
        return words

    rows = []
    for n in range(240):
        desc, code = rng.choices(voc, k=rng.randrange(3, 16)), [f"{w}()" for w in rng.choices(voc, k=rng.randrange(4, 20))]
        rows.append((2 * n, "train", "a", None, None, " ".join(desc), " ; ".join(code), 1, "", 0))
        rows.append((2 * n + 1, "test", "a", None, None, " ".join(edit(desc, n % 3)), " ; ".join(edit(code, n // 3 % 4)), 1, "", 0))
    got = {(r["eval_no"], r["train_no"]) for r in p5.overlaps(spark.createDataFrame(rows, PAIRS)).collect()}
    d, c = [p5.description_words(r[5]) for r in rows], [p5.code_words(r[6]) for r in rows]
    want = {(e, t) for e in range(1, 480, 2) for t in range(0, 480, 2) if d[e] and p5.near_same(d[e], d[t], "description") and p5.near_same(c[e], c[t], "code")}
    assert got == want and len(want) > 100


def test_in_order():
    assert p5.in_order(list("abcdef"), list("abxdef")) == 5 / 6 and p5.in_order([], ["a"]) == 0


def test_fractions_against_brute_force(spark):
    """Shared chunks of every evaluation record, by cutting each text alone."""
    rng = random.Random(9)
    voc = [f"w{i}" for i in range(60)]
    rows = []
    for n in range(200):
        desc, code = rng.choices(voc, k=rng.randrange(1, 30)), [f"{w}()" for w in rng.choices(voc, k=rng.randrange(1, 30))]
        if n % 3 == 0 and rows:
            old = rng.choice(rows)
            desc, code = old[5].split()[: rng.randrange(1, 40)] + desc[:3], code
        rows.append((n, rng.choice(["train", "Test ", "valid"]), rng.choice(["a", None]), None, None, " ".join(desc), " ; ".join(code), 1, "", 0))
    rows += [(500, "test", "a", None, None, None, "x = 1", 1, "", 0), rows[0]]

    def cut(words):
        h = [xxhash.xxh64_intdigest(w) for w in words]
        out, begin = [], 0
        for i in range(len(words)):
            r = 0
            for back in range(p5.CHUNK_WINDOW):
                if i >= back:
                    x = h[i - back]
                    r ^= (x << 7 * back | x >> 64 - 7 * back) & (2**64 - 1) if back else x
            if (r * 0x9E3779B97F4A7C15 % 2**64 >> 32) % p5.CHUNK_MEAN == 0 or i + 1 == len(words):
                out.append(tuple(words[begin : i + 1]))
                begin = i + 1
        return out

    texts = {r[0]: (r[1].strip().lower(), {"description": p5.description_words(r[5]), "code": p5.code_words(r[6])}) for r in rows if p5.description_words(r[5])}
    have = {p: {c for s, t in texts.values() if s == "train" for c in cut(t[p])} for p in ("description", "code")}
    want = {(n, p): (len(t[p]), sum(len(c) for c in cut(t[p]) if c in have[p])) for n, (s, t) in texts.items() if s != "train" for p in t}
    got = {(r["pair_no"], r["part"]): (r["words"], r["shared"]) for r in p5.fractions(spark.createDataFrame(rows, PAIRS)).collect()}
    assert got == want and sum(s for _, s in want.values()) > 50
    assert p5.fractions(spark.createDataFrame([], PAIRS)).count() == 0
