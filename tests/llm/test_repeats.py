"""Line, word and byte repeats against brute force."""

import hashlib
import random

import numpy as np
import pytest

from terrazzo.llm import anchors, linededup, repeats, substring, suffixes


def texts(seed, n=40):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "be", "gamma", "d", "epsilon", "zeta", "é"]) + str(rng.randrange(40))
    shared = [" ".join(word() for _ in range(60)) for _ in range(4)]
    out = []
    for k in range(n):
        parts = [" ".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(rng.randrange(1, 4))]
        if rng.random() < 0.6:
            s = rng.choice(shared).split()
            a = rng.randrange(0, 30)
            parts.insert(rng.randrange(len(parts) + 1), " ".join(s[a : a + rng.randrange(10, 60)]))
        out.append("\n".join(parts))
    out += [out[0], out[1] + " tail", "of " * 90, "ab" * 300, "x" * 30]
    return out


def brute_words(rows, window):
    first, out = {}, {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), (i, k))
    for i, t in rows:
        w = t.split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] != (i, k):
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def brute_bytes(rows, window):
    seen, out = {}, {}
    data = {i: t.encode() for i, t in rows}
    for i, b in data.items():
        for k in range(len(b) - window + 1):
            seen.setdefault(b[k : k + window], []).append(i)
    for i, b in data.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - window + 1):
            if len(seen[b[k : k + window]]) > 1:
                gone[k : k + window] = True
        edges = np.diff(np.r_[0, gone.astype(int), 0])
        out[i] = (len(b), int(gone.sum()), int((edges == 1).sum()), bytes(x for x, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("seed,window", [(1, 20), (2, 5)])
def test_word_repeats(frame, seed, window):
    rows = list(enumerate(texts(seed)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(frame(rows), window).collect()}
    assert got == brute_words(rows, window)


@pytest.mark.parametrize("seed,window", [(3, 120), (4, 40), (5, 70)])
def test_byte_repeats(frame, seed, window):
    rows = list(enumerate(texts(seed)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(frame(rows), window).collect()}
    assert got == brute_bytes(rows, window)


def test_byte_repeats_at_the_window_of_the_query(frame, monkeypatch):
    rng = random.Random(12)
    rows = [(i, (t + " ") * rng.randrange(1, 4) + rng.choice(texts(9)) * 2) for i, t in enumerate(texts(13, 60))]
    rows += [(500 + k, "left %d " % k + "shared passage of many words " * 20 + " right %d" % k) for k in range(30)]
    want = brute_bytes(rows, suffixes.WINDOW)
    assert 0 < sum(r[1] for r in want.values()) < sum(r[0] for r in want.values())
    for limit in (repeats.LIMIT, 5):
        monkeypatch.setattr(repeats, "LIMIT", limit)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(frame(rows)).collect()}
        assert got == want


def test_windows_of_hot_anchors(frame, monkeypatch):
    monkeypatch.setattr(repeats, "LIMIT", 3)
    rows = list(enumerate(texts(14)))
    rows += [(100 + k, f"a{k} b{k} " + " ".join(f"p{j}" for j in range(30)) + f" c{k}") for k in range(40)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(frame(rows), 20).collect()}
    assert got == brute_words(rows, 20)


def test_blocks_of_hot_anchors(frame, monkeypatch):
    rng = random.Random(21)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = letters(700)
    rows = [(k, letters(350) + passage + letters(350)) for k in range(30)] + [(100 + k, letters(320) + "in " * (150 + k) + letters(320)) for k in range(12)]
    made, write = {}, repeats.materialize

    def counted(df, tag):
        out = write(df, tag)
        made[tag] = made.get(tag, 0) + out[0].count()
        return out

    monkeypatch.setattr(repeats, "LIMIT", 3)
    monkeypatch.setattr(repeats, "materialize", counted)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(frame(rows)).collect()}
    assert got == brute_bytes(rows, suffixes.WINDOW)
    regions = repeats.all_regions(repeats.keyed(frame(rows)), suffixes.byte_tokens, suffixes.WINDOW, suffixes.GRAM).dropDuplicates(["anchor", "content"]).collect()
    contents = {}
    for r in regions:
        contents.setdefault(r.anchor, []).append(repeats.extents(r.extent)[0])
    windows = sum(sum(c) for c in contents.values() if len(c) > 3)
    # Windows of hot anchors travel in blocks; few become rows of their own.
    assert windows > 2000 and 0 < made["blocks"] + made.get("windows", 0) < windows / 4


@pytest.mark.parametrize("size", [1, 4, 32, 500])
def test_equal_windows_share_a_block(frame, size):
    rows = list(enumerate(texts(15)))
    tokens, window, gram, joined = suffixes.byte_tokens, 120, 30, {i: t.encode() for i, t in rows}
    found = repeats.all_regions(repeats.keyed(frame(rows)), tokens, window, gram).where("more is null").collect()
    cut = suffixes._cut
    bare = [(r.anchor, r.doc_id, r.tag, r.place, r.extent, False, joined[r.doc_id][r.place : r.place + repeats.extents(r.extent)[0] + window - 1]) for r in found]
    blocks = repeats.divided(frame([]).sparkSession.createDataFrame(bare, repeats.BARE), cut, window, gram, size).collect()
    places, keys = [], {}
    for b in blocks:
        n = repeats.extents(b.extent)[0]
        assert n <= size and bytes(b.payload) == joined[b.doc_id][b.place : b.place + n + window - 1]
        places += [(b.doc_id, b.place + k) for k in range(n)]
        for k in range(n):
            assert keys.setdefault(bytes(b.payload[k : k + window]), b.anchor) == b.anchor
    assert len(places) == len(set(places)) == sum(repeats.extents(r.extent)[0] for r in found)


def test_texts_that_repeat_themselves(frame, spark):
    rows = [(1, "x " * 500 + "end"), (2, "a b c d e f g h " * 60), (3, "start " + "x " * 300), (4, "q " * 25 + "y z " * 40), (5, "unique words only in this text of more than a few")]
    docs = frame(rows)
    found = repeats.all_regions(repeats.keyed(docs), substring.word_tokens, 20, 6)
    assert found.groupBy("doc_id", "anchor", "content").count().where("count > 1").count() == 0 and found.count() < 120
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(docs, 20).collect()}
    assert got == brute_words(rows, 20)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(docs, 100).collect()}
    assert got == brute_bytes(rows, 100)


def test_difference_cover():
    assert {(a - b) % suffixes.COVER for a in suffixes.RESIDUES for b in suffixes.RESIDUES} == set(range(suffixes.COVER))
    for a in range(suffixes.COVER):
        for b in range(suffixes.COVER):
            assert {(a + suffixes.SHIFT[a, b]) % suffixes.COVER, (b + suffixes.SHIFT[a, b]) % suffixes.COVER} <= set(suffixes.RESIDUES)


@pytest.mark.parametrize("window", [40, 61, 62, 93, 130, 400])
def test_suffix_ranks_are_those_of_sorting(window):
    rng = random.Random(window)
    passage = "".join(rng.choice("ab") for _ in range(900))
    text = ("a" * 700 + passage + "b" + passage[100:800] + "ab" * 300 + passage[37:] + "c" * 10 + passage).encode()
    starts = np.array(rng.sample(range(len(text) - window + 1), 1500))
    got = suffixes.window_ranks(np.frombuffer(text, np.uint8), starts, window)
    strings = [text[s : s + window] for s in starts]
    place = {x: k for k, x in reversed(list(enumerate(sorted(strings))))}
    want = [place[x] for x in strings]
    # Equal windows share a rank, and ranks are in the order of the windows.
    assert np.unique(got, return_inverse=True)[1].tolist() == np.unique(want, return_inverse=True)[1].tolist()


def test_contents_are_told_apart_where_polynomials_collide():
    def thue(n, a, b):
        return a if n == 0 else thue(n - 1, a, b) + thue(n - 1, b, a)

    x, y = (thue(11, *p) for p in (("'", "C"), ("C", "'")))
    head = "".join(chr(97 + k * 7 % 26) for k in range(200))
    both = [anchors.regions(*suffixes.byte_tokens(head + t), len(head + t), 100) for t in (x, y)]
    assert both[0].content[0] != both[1].content[0]


def test_regions_own_every_window_once(monkeypatch):
    rng = np.random.default_rng(0)
    tokens = anchors.mixed(rng.integers(0, 5, 5000).astype(np.uint64))
    for piece in (anchors.PIECE, 700):
        monkeypatch.setattr(anchors, "PIECE", piece)
        r = anchors.regions(tokens, tokens.tobytes(), 30, 4)
        assert r.lo[0] == 0 and (r.lo[1:] == r.lo[:-1] + r.count[:-1]).all() and r.count.sum() == 5000 - 29
        at = np.repeat(r.anchor, r.count)
        windows = {}
        for k in range(len(at)):
            assert windows.setdefault(tokens[k : k + 30].tobytes(), at[k]) == at[k]
    assert len(anchors.regions(tokens[:10], tokens[:10].tobytes(), 30, 4).lo) == 0


def test_reference_shards(frame, spark, monkeypatch):
    monkeypatch.setattr(substring, "SHARD", 25)
    monkeypatch.setattr(substring, "BROADCAST", 5000)
    passage = " ".join(f"p{k}" + "x" * (k % 20) for k in range(70))
    rows = [(1, "a b " + " ".join(passage.split()[10:40]) + " c"), (2, "nothing here"), (3, None), (4, passage)]
    reference = spark.createDataFrame([(passage,), (None,), (passage,), ("too short",)], "text string")
    got = {r.doc_id: (r.n_removed, r.kept) for r in substring.remove_against(frame(rows), reference, 8).collect()}
    assert got == {1: (30, "a b c"), 2: (0, "nothing here"), 3: (0, ""), 4: (70, "")}
    assert substring.remove_against(frame(rows), reference.limit(0), 8).where("n_removed > 0").count() == 0


def test_line_windows(frame, spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc"), (3, "b\nc\nd\ny\nb\nc\nd"), (4, "a\nb"), (5, "a\nb")]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in linededup.remove_repeats(frame(rows)).collect()}
    assert got == {1: (4, 0, "a\nb\nc\nd"), 2: (4, 3, "x"), 3: (7, 6, "y"), 4: (2, 0, "a\nb"), 5: (2, 0, "a\nb")}
    stripped = {r.doc_id: (r.text, r.n_chars) for r in linededup.strip(frame(rows)).collect()}
    assert stripped[2] == ("x", 1) and stripped[3] == ("y", 1) and stripped[1] == ("a\nb\nc\nd", 7)


def test_odd_rows(odd, none):
    words = {(r.doc_id, r.n_words): r.n_removed for r in substring.remove_repeats(odd).collect()}
    # The long text repeats inside itself: only its first 97 words and the last of a window stay.
    assert words[1, 0] == words[2, 0] == words[3, 0] == words[None, 4] == 0
    assert words[8, 9000] == 9000 and words[7, 9000] == 9000 - 97
    many = suffixes.remove_repeats(odd, digest=True).collect()
    assert len(many) == 11 and sum(r.n_removed for r in many if r.doc_id in (7, 8)) == sum(r.n_bytes for r in many if r.doc_id in (7, 8))
    lines = {r.doc_id: (r.n_lines, r.n_removed) for r in linededup.remove_repeats(odd).collect() if r.doc_id != 5}
    assert lines[1] == (0, 0) and lines[2] == (1, 0) and lines[9] == (6, 5)
    assert linededup.strip(odd).count() == 11 and linededup.strip(odd).columns == odd.columns
    for f in (substring.remove_repeats, suffixes.remove_repeats, linededup.remove_repeats, linededup.strip):
        assert f(none).count() == 0


def test_digests(frame):
    r = substring.remove_repeats(frame([(1, "a  b\tc")]), digest=True).first()
    assert r.kept == hashlib.sha256(b"a b c").hexdigest()
