"""SimHash, SpotSigs and embeddings against brute force."""

import hashlib
import random

import numpy as np
import regex
import xxhash
from pyspark.sql import functions as F

from terrazzo.llm import embeddings, simhash, spotsigs, tiles


def components(n, linked):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in linked:
        x, y = root(a), root(b)
        label[max(x, y)] = min(x, y)
    return [root(x) for x in range(n)]


def test_fingerprint():
    text = "The Quick brownÄ fox  jumps\tover the lazy dog"
    w = "".join(c.lower() if c.isascii() else c for c in text).split()
    counts = np.zeros(64, int)
    for k in range(len(w) - 3):
        h = xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42)
        counts += [(h >> j) & 1 for j in range(64)]
    want = sum(1 << j for j in range(64) if 2 * counts[j] > len(w) - 3)
    assert simhash.fingerprint(simhash.shingle_hashes(text, 4)) == want
    assert simhash.fingerprint(simhash.shingle_hashes("One two", 4)) == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.fingerprint(simhash.shingle_hashes(None, 4)) == 0


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    codes = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for b in base]))
    got = {(int(a), int(b)) for x, y in simhash.GrayIndex(codes).within(codes, 3) for a, b in zip(x, y)}
    far = np.bitwise_count(codes[:, None] ^ codes[None, :])
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(far <= 3))}
    ranks = simhash.gray_rank(np.arange(16, dtype=np.uint64) ^ (np.arange(16, dtype=np.uint64) >> np.uint64(1)))
    assert ranks.tolist() == list(range(16))


def test_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 50)
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    codes = np.unique(np.concatenate([codes, *[codes[0] ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for _ in range(3)]]))
    reps = spark.createDataFrame([(int(c), k) for k, c in enumerate(codes.view(np.int64))], "fp long, rep long")
    far = np.bitwise_count(codes[:, None] ^ codes[None, :])
    for blocks in (None, 6, 8):
        linked = [(r.a, r.b) for r in simhash.links(reps, 4, blocks).collect()]
        assert components(len(codes), linked) == components(len(codes), list(zip(*np.nonzero(far <= 4))))


def test_keys_lengthen_with_the_fingerprints():
    counts = [simhash.block_count(n, 4) for n in (0, 10**6, 10**8, 10**10, 10**12, 10**15)]
    assert counts == sorted(counts) and counts[0] == 5 and counts[-1] <= 8


def test_simhash_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd, words=4).collect()
    got = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    zero = "0" * 16
    assert len(rows) == 11 and got[1, zero] == got[2, zero] == got[3, zero] == got[9, zero] == 1
    one = f"{xxhash.xxh64_intdigest(b'one', 42):016x}"
    assert got[4, one] == got[5, one] == 4 and [v for (i, _), v in got.items() if i is None] == [None]
    assert simhash.near_duplicates(none).count() == 0


def test_keep_one(frame, odd, none):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    near = base[:]
    near[150] = "changed"
    half = base[:150] + [f"v{rng.randrange(5000)}" for _ in range(150)]
    rows = [(10, " ".join(base)), (11, " ".join(near)), (12, " ".join(base)), (13, " ".join(half)), (14, "a short one")]
    assert sorted(r.doc_id for r in simhash.keep_one(frame(rows)).collect()) == [10, 13, 14]
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in kept.collect() if r.doc_id != 5) == [(0, 12), (1, 0), (4, 3), (7, len(odd.where("doc_id = 7").first().text))]
    assert simhash.keep_one(none).count() == 0
    other = "another text of the same id, and long enough for shingles"
    many = frame([(1, " ".join(base)), (1, other), (1, other), (None, other), (None, "no id, but a text of its own")]).selectExpr("*", "7 as _id", "8 as _row", "9 as node", "1 as _n")
    rows = simhash.keep_one(many)
    assert rows.columns == many.columns and sorted((r.doc_id or 0, len(r.text)) for r in rows.collect()) == sorted([(1, len(" ".join(base))), (1, len(other)), (0, 28)])


def test_similar_is_exact_on_both_sides(frame, monkeypatch):
    monkeypatch.setattr(simhash, "SETS", 20)
    rng = random.Random(11)
    rows, sets = [], []
    for k in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        rows.append(base)
        for cuts in (3, 4, 5, 7, 8):
            other = base[:]
            # Each word changed replaces five shingles of 200.
            for at in range(cuts):
                other[5 + at * 12] = f"x{rng.randrange(10**6)}"
            rows.append(other)
    rows = [(k, " ".join(w)) for k, w in enumerate(rows)]
    sets = [set(zip(*(t.split()[j:] for j in range(5)))) for _, t in rows]
    share = lambda a, b: len(a & b) / len(a | b)
    linked = [(a, b) for g in range(0, 360, 6) for a in range(g, g + 6) for b in range(a) if b >= g and share(sets[a], sets[b]) >= 0.8]
    got = {r.doc_id: r.component_id for r in simhash.similar(frame(rows)).collect()}
    assert [got[k] for k in range(360)] == components(360, linked)


def test_equal_fingerprints_of_unlike_sets_stay_apart(frame):
    loud = "a b c d e f g h i j " * 200
    rows = [(1, loud), (2, loud + " ".join(f"z{k}" for k in range(60)))]
    assert {r.component_id for r in simhash.similar(frame(rows)).collect()} == {1, 2}


def test_tiles_meet_every_pair_once_or_more(spark):
    rows = spark.range(40).selectExpr("id as k", "id % 3 as key")
    dealt = tiles.tiled(rows, "key", "k", 5).select("key", "_lo", "_hi", "k").collect()
    groups = {}
    for r in dealt:
        groups.setdefault((r.key, r._lo, r._hi), set()).add(r.k)
    met = {(a, b) for g in groups.values() for a in g for b in g}
    assert met == {(a, b) for a in range(40) for b in range(40) if a % 3 == b % 3}


def test_against_edit(frame, odd, none):
    rows = [(3, "the cat sat on the mat and the dog ran to the house " * 3), (1, "ab"), (2, None), (9, "le chat noir dort sur la table verte de la maison " * 3), (4, "😀" * 9)]
    df = spotsigs.against_edit(frame(rows))
    got = {r.doc_id: r for r in df.collect()}
    texts = {i: t or "" for i, t in rows}
    order = sorted(texts)
    for i, after in zip(order, order[1:] + order[:1]):
        t, cut = texts[i], len(texts[i]) // 4
        edited = t[: len(t) - cut] + texts[after][:cut]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[3].near_edited > 0.5 > got[3].near_next and got[2].fingerprint == "" and got[1].near_edited == 1
    assert spotsigs.against_edit(odd).count() == 11 and spotsigs.against_edit(none).count() == 0
    alone = spotsigs.against_edit(frame([(1, "a b c d e f g h")])).first()
    assert alone.near_next == 1.0


def brute_signatures(text):
    """Signatures word by word, as the module's description has them."""
    norm = regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).strip(" ")
    w, common = norm.split(" ") if norm else [], set(spotsigs.COMMON)

    def content(k):
        while k < len(w) - 1 and w[k] in common:
            k += 1
        return k

    out = []
    for i in range(len(w)):
        if w[i] in common and (j := content(i + 1)) < len(w) and (k := content(j + 1)) < len(w):
            out.append(f"{w[i]} {w[j]} {w[k]}")
    cuts = [-1, *(k for k, x in enumerate(w) if x in common), len(w)]
    for a, b in zip(cuts, cuts[1:]):
        if b - a - 1 >= spotsigs.SPARSE:
            out += [f"{x} {y}" for x, y in zip(w[a + 1 : b - 1], w[a + 2 : b])]
    if not out:
        out = [f"{x} {y}" for x, y in zip(w, w[1:])] or ([norm or text] if text else [])
    return {xxhash.xxh64_intdigest(x.encode(), 42) & 0xFFFFFFFF for x in out}


def test_signatures_against_brute_force(spark, frame):
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10**6 + k, t) for k, t in enumerate(["", None, "the", "the of", "The cat", "...", "the of and cat dog of", "a b c d e f g h i j k l m n", "été le chat noir de la nuit et der Hund"])]
    texts = {i: t or "" for i, t in rows}
    order = sorted(texts)
    got = {r.doc_id: r for r in spotsigs.against_edit(frame(rows)).collect()}
    assert len(got) == len(rows)
    for i, after in zip(order, order[1:] + order[:1]):
        t, cut = texts[i], len(texts[i]) // 4
        own, other, following = (brute_signatures(x) for x in (t, t[: len(t) - cut] + texts[after][:cut], texts[after]))
        text = lambda sigs: "".join(f"{x:08x}" for x in sorted(sigs))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (text(own), text(other)), t[:80]
        assert abs(got[i].near_edited - share(own, other)) < 1e-12 and abs(got[i].near_next - share(own, following)) < 1e-12


def test_scarce_spots_do_not_change_the_kind_of_a_set(frame):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    text = lambda gap: " ".join("the" if k % gap == 0 else word() for k in range(400))
    rows = [(k, text(gap)) for k, gap in enumerate((7, 9, 8, 30, 6, 500, 8, 10))]
    for r in spotsigs.against_edit(frame(rows)).collect():
        assert 0.15 < r.near_edited < 0.9 and r.near_next < 0.1


def test_against_edit_over_many_buckets(frame, monkeypatch):
    monkeypatch.setattr(spotsigs, "BUCKET", 3)
    monkeypatch.setattr(spotsigs, "PIECES", 4)
    ids = [1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 1000, 1001, 1002, 50_000, 50_001, 9_000_000]
    rows = [(i, f"text number {i} of the list") for i in ids]
    got = {r.doc_id: r.next_text for r in spotsigs.with_next(frame(rows)).collect()}
    assert got == {i: f"text number {n} of the list" for i, n in zip(ids, ids[1:] + ids[:1])}
    void = [f"no id, text {k}" for k in range(50)]
    void.sort(key=lambda t: np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))
    rows += [(None, t) for t in void]
    found = {r.text: r.next_text for r in spotsigs.with_next(frame(rows)).collect()}
    texts = [t for _, t in rows]
    assert found == dict(zip(texts, texts[1:] + texts[:1]))


def test_spot_duplicates(frame, odd, none):
    base = "the quick brown fox of the woods and a lazy dog in the yard by the house on the hill with a view"
    rows = [(1, base), (2, base + " ok"), (3, base), (4, "la maison de la rue et le jardin des fleurs sur le toit avec une vue"), (5, None)]
    got = {r.doc_id: (r.component_id, r.n_links) for r in spotsigs.near_duplicates(frame(rows)).collect()}
    assert got[1] == got[3] == (1, 1) and got[2] == (1, 1) and got[4] == (4, 0) and got[5] == (5, 0)
    assert spotsigs.near_duplicates(odd).count() == 11 and spotsigs.near_duplicates(none).count() == 0


def test_spot_classes_against_brute_force(frame):
    rng = random.Random(17)
    common = "the sun of the day and the moon in the night"
    texts = []
    for _ in range(12):
        base = [f"the w{rng.randrange(10**5)} x{rng.randrange(10**5)}" for _ in range(rng.randrange(6, 40))]
        for _ in range(6):
            other = base[:]
            for _ in range(rng.randrange(0, 5)):
                other[rng.randrange(len(other))] = f"of y{rng.randrange(10**5)} z{rng.randrange(10**5)}"
            # All texts share what is common, a third of them nothing else.
            texts.append(" . ".join([common, *other]) if rng.random() < 0.7 else common)
    rows = list(enumerate(texts))
    sets = [brute_signatures(t) for t in texts]
    alike = [[len(a & b) / len(a | b) >= 0.8 for b in sets] for a in sets]
    label = components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if alike[a][b]])
    got = {r.doc_id: (r.component_id, r.n_links) for r in spotsigs.near_duplicates(frame(rows)).collect()}
    for i in range(len(rows)):
        links = {frozenset(sets[j]) for j in range(len(rows)) if alike[i][j]} - {frozenset(sets[i])}
        assert got[i] == (label[i], len(links))


def vectors(seed, n=300, dim=24):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for k in range(40):
        x[rng.integers(n)] = x[rng.integers(n)] * rng.uniform(0.5, 2) + rng.standard_normal(dim) * 0.12
    x[5], x[6] = x[4], x[4]
    return x


def test_embedding_links(spark, monkeypatch):
    x = vectors(1)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    want = components(len(x), list(zip(*np.nonzero(near))))
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(3)
    for tile in (embeddings.TILE, 8):
        monkeypatch.setattr(embeddings, "TILE", tile)
        rows = sorted(embeddings.near_duplicates(df).collect(), key=lambda r: r.vec_id)
        links = np.array([r.n_links for r in rows])
        assert (links <= near.sum(1) - 1).all() and links.sum() >= 0.9 * (near.sum() - len(x))
        assert np.mean([r.component_id == w for r, w in zip(rows, want)]) > 0.99
        assert all(r.kept == (r.component_id == r.vec_id) for r in rows)


def test_calibration():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((4000, embeddings.LINES))
    rounded = lambda x: np.rint(x / embeddings.STEP)
    hit = np.abs(rounded(a) - rounded(a + rng.standard_normal(a.shape) * np.sqrt(0.1))) <= embeddings.HALF
    for lines in (embeddings.FIRST, embeddings.LINES):
        assert (hit[:, :lines].sum(1) < embeddings.least_collisions(0.95, lines)).mean() < 0.005
    width, tables = embeddings.plan(100_000, 0.95)
    assert 1 - (1 - embeddings.cell_share(np.sqrt(0.1)) ** width) ** tables >= embeddings.RECALL


def test_collisions_against_all_pairs(monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 500)
    rng = np.random.default_rng(3)
    x = np.rint(rng.standard_normal((90, embeddings.LINES)) * 12).astype(np.int16)
    bounds = (9, 14)
    hit = np.abs(x[:40, None] - x[None]) <= embeddings.HALF
    want = set(zip(*np.nonzero((hit[:, :, : embeddings.FIRST].sum(2) >= 9) & (hit.sum(2) >= 14))))
    got = [(a, b) for p, q in embeddings.collisions(x[:40], x, bounds) for a, b in zip(p, q)]
    assert len(got) == len(set(got)) and set(got) == want


def test_recall_on_planted_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((1500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    rows = [base]
    for cosine in (0.95, 0.952, 0.96, 0.98):
        side = rng.standard_normal((400, 64))
        side -= (side * base[:400]).sum(1)[:, None] * base[:400]
        side /= np.linalg.norm(side, axis=1)[:, None]
        rows.append(cosine * base[:400] + np.sqrt(1 - cosine**2) * side)
    x = np.concatenate(rows).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).collect()}
    want = near.sum(1) - 1
    assert all(got[k] <= want[k] for k in got) and sum(got.values()) >= 0.99 * want.sum() > 2000


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit(1)).withColumn("key", F.lit("k"))
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()), key=str)
    assert [g[1:] for g in got if g[0] in (1, 2, 3, 4, 5, 6, 9)] == [(0, i, True) for i in (1, 2, 3, 4, 5, 6, 9)]
    assert [g for g in got if g[0] == 7] == [(7, 3, 7, True)] and [g for g in got if g[0] == 8] == [(8, 3, 7, False)] * 2
    assert embeddings.near_duplicates(df.where("vec_id > 100")).count() == 0
