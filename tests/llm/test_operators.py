"""Operators against brute-force versions, exact round trips or held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamstat.llm import chat_format, common, decontamination, jaccard_join, license_scan, media_chunks, mixing, quality, token_counts, toxicity, warc
from loamstat.llm.common import mix64
from loamstat.llm.wordhash import ALNUM, SPACED, ngrams, words


def lower(x: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def flat(texts: list[str]):
    return common.flat_bytes(pa.array(texts))


SAMPLES = ["Ab c", "", "  x\ty\n", "größer ñ-1 東京!", "a b a b a b", "\x00z\x1fq", "AB ab"]


def test_words_and_ngrams_match_regex():
    data, offs = flat(SAMPLES)
    for kind, pattern in ((SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = words(data, offs, kind)
        want = [(i, x) for i, t in enumerate(SAMPLES) for x in re.findall(pattern, lower(t))]
        got = [(int(d), lower(data[a:b].tobytes().decode())) for d, a, b in zip(w.doc, w.start, w.end, strict=True)]
        assert got == want
        by_hash: dict[int, str] = {}
        for h, (_, x) in zip(w.hash, want, strict=True):
            assert by_hash.setdefault(int(h), x) == x
        assert len(set(by_hash.values())) == len(by_hash)
        h, at = ngrams(w, 2)
        assert [int(i) for i in at] == [i for i in range(len(want) - 1) if want[i][0] == want[i + 1][0]]


def test_slices_keep_whole_rows():
    batch = pa.RecordBatch.from_pydict({"i": [1, 2, 3, 4], "text": ["a" * 10, None, "b" * 100, "c"]})
    got = [(p.column(0).to_pylist(), bytes(d)) for p, d, _ in common.text_slices(iter([batch]), "text", 12)]
    assert got == [([1, 2], b"a" * 10), ([3], b"b" * 100), ([4], b"c")]


def family(rng: random.Random, n_docs: int, sizes=(4, 400)) -> list[str]:
    """Base texts with copies mutated at rates around the thresholds."""
    out = []
    vocabulary = [f"v{i}" for i in range(3000)]
    while len(out) < n_docs:
        base = [rng.choice(vocabulary) for _ in range(rng.randint(*sizes))]
        for _ in range(rng.randint(1, 12)):
            copy = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0, 0.005, 0.02, 0.04]) else w for w in base]
            if rng.random() < 0.2:
                copy = copy[: max(1, int(len(copy) * rng.uniform(0.85, 1)))]
            out.append(" ".join(copy))
    return out


def brute_components(texts: list[str], n: int, num: int, den: int) -> list[int]:
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append(frozenset(zip(*[w[i:] for i in range(n)])) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) * den >= num * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize(("n", "num", "den", "volume"), [(3, 9, 10, 400_000), (3, 9, 10, 600), (5, 8, 10, 2000), (2, 1, 2, 5000)])
def test_jaccard_components_match_brute_force(spark, n, num, den, volume):
    low = num * 3 < den * 2  # such thresholds cost the square of a set's size
    texts = family(random.Random(n * num), 260, (4, 90) if low else (4, 400))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard_join.jaccard_components(docs, n, num, den, group_volume=volume).toPandas().sort_values("doc_id")
    assert got.component_id.tolist() == brute_components(texts, n, num, den)
    kept = jaccard_join.deduplicate(docs, n, num, den, group_volume=volume).toPandas()
    assert sorted(kept.doc_id) == sorted(set(brute_components(texts, n, num, den)))


def test_coarse_tokens_lose_no_pair():
    """Sets that differ as much as the threshold allows share a coarse token, at every size."""
    rng = np.random.default_rng(3)
    for num, den in ((9, 10), (8, 10), (3, 5), (1, 2)):
        wide = num * 3 >= den * 2
        for size in [*range(2, 60), 97, 150, 333, 1200] if wide else [*range(2, 24), 40]:
            for _ in range(4 if wide else 2):
                common_part = rng.integers(0, 1 << 63, size, dtype=np.uint64)
                extra = int(size * (den - num) / num)  # |A & B| = size, |A | B| = size + extra
                cut = rng.integers(0, extra + 1)
                more = rng.integers(0, 1 << 63, extra, dtype=np.uint64)
                a, b = np.unique(np.concatenate([common_part, more[:cut]])), np.unique(np.concatenate([common_part, more[cut:]]))
                (ca, na), (cb, nb) = jaccard_join.coarse_tokens(a, num, den), jaccard_join.coarse_tokens(b, num, den)
                both = len(np.intersect1d(ca, cb))
                assert both >= max(na, nb) or np.array_equal(a, b) or len(np.intersect1d(a, b)) * den < num * len(np.union1d(a, b))


def test_a_family_of_near_copies_takes_few_comparisons(monkeypatch):
    """One changed word a text: one pivot joins them all; two families and their bridge take a few more."""
    probes = []
    real = jaccard_join._Group.linked
    monkeypatch.setattr(jaccard_join._Group, "linked", lambda self, x, allowed: (probes.append(x), real(self, x, allowed))[1])

    def sets_of(template, rows):
        return [jaccard_join.Shingles(*(np.sort(np.concatenate([template[i % 7 * 5 + 5 :], np.arange(1, 6, dtype=np.uint64) * np.uint64(i + 10**9)])) for _ in range(2))) for i in rows]

    def joined(sets):
        probes.clear()
        links = jaccard_join.open_group(np.arange(len(sets)), [s.hash for s in sets], [s.check for s in sets], np.ones(len(sets), bool), True, 8, 10)
        root = list(range(len(sets)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in links:
            assert find(a) != find(b)  # a forest
            root[find(a)] = find(b)
        return len({find(i) for i in range(len(sets))})

    one, two = np.arange(1000, 1200, dtype=np.uint64), np.arange(5000, 5200, dtype=np.uint64)
    assert joined(sets_of(one, range(3_000))) == 1 and len(probes) == 1
    assert joined(sets_of(one, range(1_500)) + sets_of(two, range(1_500, 3_000))) == 2 and len(probes) == 2
    chain = [jaccard_join.Shingles(np.arange(10 * i, 10 * i + 200, dtype=np.uint64), np.arange(10 * i, 10 * i + 200, dtype=np.uint64)) for i in range(40)]
    assert joined(chain) == 1


def mirror(n: int) -> tuple[str, str]:
    """A Thue-Morse word of n letters and its complement: equal under any power-sum hash that wraps at 2^64."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_structured_words_stay_apart(spark):
    sizes = [8, 64, 1024, 2048]
    assert all(len(x) == n and mirror(n)[0] != mirror(n)[1] for n in sizes for x in mirror(n))
    rows = [(10 * i + j, x) for i, n in enumerate(sizes) for j, x in enumerate((*mirror(n), mirror(n)[0].upper()))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_components(docs).toPandas().set_index("doc_id")
    assert got.component_id.to_dict() == {d: d - 2 if d % 10 == 2 else d for d, _ in rows}
    items = spark.createDataFrame([(n, mirror(n)[0]) for n in sizes], "item_id long, text string")
    hits = decontamination.contamination(docs, items).toPandas().set_index("doc_id")
    assert hits.n_hit.to_dict() == {d: int(d % 10 != 1) for d, _ in rows}


def cut_to_16_bits(w):
    return w._replace(hash=mix64(w.hash & np.uint64(0xFFFF)))


def test_jaccard_is_right_with_16_bit_hashes(spark, monkeypatch):
    """With first lanes of 16 bits, sets, signatures and the opened groups still tell all shingles apart."""
    texts = [t for t in family(random.Random(2), 120, (300, 900))]
    real, grams = jaccard_join.words, jaccard_join.ngrams
    monkeypatch.setattr(jaccard_join, "words", lambda *a, **k: cut_to_16_bits(real(*a, **k)))
    monkeypatch.setattr(jaccard_join, "ngrams", lambda *a: (lambda h, at: (h & np.uint64(0xFFFF), at))(*grams(*a)))
    sets = jaccard_join.shingle_sets(*flat(texts), 3)
    plain = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in texts]
    assert [s.size for s in sets] == [len(set(zip(w, w[1:], w[2:]))) for w in plain]
    assert sum(len(np.unique(s.hash)) < s.size for s in sets) > 10
    marks = [jaccard_join.signature(s) for s in sets]
    assert len(set(marks)) == len({frozenset(zip(w, w[1:], w[2:])) for w in plain})
    sigs = np.arange(len(sets))
    links = jaccard_join.open_group(sigs, [s.hash for s in sets], [s.check for s in sets], np.ones(len(sets), bool), True, 9, 10)
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert root == brute_components(texts, 3, 9, 10)


def test_clashing_signatures_get_nodes_of_their_own(spark):
    rows = [(1, b"1" * 16, 3, 7, 1), (2, b"2" * 16, 3, 7, 2), (3, b"3" * 16, 3, 7, 2), (4, b"4" * 16, 3, 8, 2), (5, b"5" * 16, 0, None, None)]
    sets, clashes = jaccard_join.with_nodes(spark.createDataFrame(rows, "id long, rowkey binary, n long, sig long, sig2 long"))
    node = {r.id: r.sig for r in sets.collect()}
    assert clashes == {7} and node[1] != node[2] == node[3] and node[4] == 8 and node[5] is None
    assert node[1] == jaccard_join.node_of((7, 1), clashes)


@pytest.mark.parametrize("most", [1 << 16, 1 << 29])
def test_bloom_filter_has_no_false_negatives(spark, most):
    """Also where far more keys than it is made for saturate it."""
    keys = spark.range(100_000).select(F.xxhash64("id").alias("k"))
    bloom = common.bloom_build(keys, most)
    mine = keys.toPandas().k.to_numpy()
    other = spark.range(100_000, 200_000).select(F.xxhash64("id").alias("k")).toPandas().k.to_numpy()
    assert common.bloom_has(bloom, mine).all()
    share = common.bloom_has(bloom, other).mean()
    assert share < 0.05 if most > 1 << 20 else share > 0.9
    docs = spark.createDataFrame([(i, "x") for i in range(50)], "doc_id long, text string")
    gone = docs.where("doc_id % 3 = 0").select(common.row_key().alias("k"))
    assert sorted(r.doc_id for r in common.drop_keys(docs, common.row_key(), gone).collect()) == [i for i in range(50) if i % 3]


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(5)
    common_words = ["the", "of", "and", "in"]
    vocabulary = common_words * 30 + [f"t{i}" for i in range(200)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 9, 10, 11, 30])))) for i in range(25)] + [(50, "the of the of the of the of the of the")]
    docs = []
    for i in range(150):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            t = rng.choice(items)[1].split()
            a = rng.randint(0, len(t) - 1)
            at = rng.randint(0, len(w))
            w[at:at] = t[a : a + rng.randint(1, 14)]
        docs.append((i, ". ".join(w).upper() if i % 3 == 0 else " ".join(w)))
    got = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).toPandas().set_index("doc_id")
    for i, text in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        hit, names = set(), set()
        for name, item in items:
            t = item.split()
            k = min(10, len(t))
            windows = {tuple(t[a : a + k]) for a in range(len(t) - k + 1)}
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in windows:
                    hit |= set(range(p, p + k))
                    names.add(str(name))
        assert (got.n_words[i], got.n_hit[i], list(got["items"][i])) == (len(w), len(hit), sorted(names)), i


def test_proximity_counts_windows_within_slop(spark):
    """``n_near`` against brute force over the windows' two rarest words."""
    rng = random.Random(8)
    vocabulary = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 6, 14])))) for i in range(12)] + [(50, "x x x"), (51, "alpha beta gamma delta")]
    docs = [(i, " ".join(rng.choice(vocabulary + ["x"]) for _ in range(rng.randint(0, 150)))) for i in range(60)]
    docs += [(100, "alpha beta gamma delta"), (101, "alpha beta x gamma y delta"), (102, "alpha " + "x " * 30 + "beta gamma delta")]
    cf: dict = {}
    for _, t in docs:
        for w in t.split():
            cf[w] = cf.get(w, 0) + 1
    windows = {tuple(w[a : a + min(10, len(w))]) for _, t in items for w in [t.split()] for a in range(len(w) - min(10, len(w)) + 1)}
    for slop in (0, 2):
        got = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), slop=slop).toPandas().set_index("doc_id")
        for i, text in docs:
            places: dict = {}
            for p, w in enumerate(text.split()):
                places.setdefault(w, []).append(p)
            near = 0
            for win in windows:
                order = sorted(set(win), key=lambda w: (cf.get(w, 0), w))
                a = order[0]
                if len(order) == 1:
                    near += a in places
                    continue
                gap = win.index(order[1]) - win.index(a)
                near += any(abs(q - p - gap) <= slop for p in places.get(a, []) for q in places.get(order[1], []))
            assert got.n_near[i] == near, (slop, i)


def test_license_base_places_match_brute_force(spark):
    rng = random.Random(9)
    phrases = [p for p, _ in license_scan.BASE_PHRASES]
    notices = [n for n, _ in license_scan.NOTICES]
    docs = []
    for i in range(120):
        w = [rng.choice(["under", "the", "mit", "license", "cc", "by", "nc", "apache", "version", "2", "zz"]) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(phrases).split()
        docs.append((i, rng.choice([" ", "-", ". "]).join(w)))
    docs += [(200 + i, "lorem ipsum " + n + " dolor") for i, n in enumerate(notices)] + [(300, None)]
    got = license_scan.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).toPandas().set_index("doc_id")
    for i, text in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
        places, labels = [], set()
        for phrase, name in license_scan.BASE_PHRASES:
            t = phrase.split()
            found = [a for a in range(len(w)) if w[a : a + len(t)] == t]
            places += found
            labels |= {name} if found else set()
        row = got.loc[i]
        assert (row.n_words, row.n_base, row.base_labels) == (len(w), len(places), ",".join(sorted(labels))), i
        if places:
            assert (row.first_word, row.last_word) == (min(places), max(places))
        assert labels <= set(row.labels.split(",")) and 0 <= row.score <= 1
    for i, (_, name) in enumerate(license_scan.NOTICES):
        assert name in got.labels[200 + i].split(",")
    assert got.labels[300] == ""


def test_license_diagonals_bridge_inserted_words(spark):
    text = license_scan.NOTICES[1][0].split()
    text[8:8] = ["really", "truly"]
    got = license_scan.license_scan(spark.createDataFrame([(1, " ".join(text)), (2, "permission is hereby denied")], "doc_id long, text string")).toPandas().set_index("doc_id")
    assert got.labels[1] == "mit" and got.n_base[1] == 0 and got.score[1] > 0.9 and got.labels[2] == ""


def test_mixing_keeps_targets_and_reruns(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "c", None, "é"]), " ".join(["w"] * rng.choice([0, 1, 5, 40, 200]))) for i in range(3000)] + [(7, "a", "w w w")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    one = mixing.mix_sources(docs, block=64).toPandas()
    two = mixing.mix_sources(docs.repartition(7), block=64).toPandas()
    key = ["doc_id", "size", "taken"]
    assert one[key].sort_values(key).values.tolist() == two[key].sort_values(key).values.tolist()
    assert len(one) == len(rows) and (one.taken <= 2 * one["size"]).all()
    size = {}
    for _, s, t in rows:
        size[s] = size.get(s, 0) + len(t.split())
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    open_, left, target = set(names), 1.5 * sum(size.values()), {}
    while True:  # stop at twice the size, share the excess again
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s] + 1e-9}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= over
    for total, g in one.groupby("source_size"):
        s = next(x for x in names if size[x] == total)
        assert np.allclose(g.target, target[s])
        assert abs(g.taken.sum() - target[s]) <= 200
    mix = mixing.repeat_mixed(docs, block=64).toPandas()
    assert len(mix) == one.copies.sum()


def test_pivotal_rounding_is_unbiased():
    rng = np.random.default_rng(1)
    p, size = rng.random(6), rng.integers(1, 9, 6)
    total = np.zeros(6)
    for k in range(4000):
        out, held = mixing.pivotal_block(p, size, np.random.default_rng(k))
        assert abs((out * size).sum() - (p * size).sum()) < 1e-9
        total += out
    assert np.abs(total / 4000 - p).max() < 0.03


def test_media_round_trip(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh ñ東") for _ in range(20_000))
    texts = [base, base, base[:9000] + "X" + base[9000:], base[5000:], "", None, "x", "y" * 70_000, *("".join(rng.choice("abc ") for _ in range(3000)) for _ in range(30))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    store = media_chunks.store_media(docs)
    media = {bytes(r.file): b"".join(bytes(c) for c in r.own) for r in media_chunks.read_media(store).collect()}
    files = {r.doc_id: bytes(r.file) for r in store.files.collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        raw += bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert media_chunks.wav_payload(media[files[i]]) == raw
    assert store.shared.count() == store.shared.select("digest").distinct().count() > 0
    got = media_chunks.media_features(docs).toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        raw = media_chunks.padded((t or "").encode())
        row = got.loc[i]
        assert (row.n_bytes, row.payload_sha256, row.tail_crc32) == (len((t or "").encode()), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
        assert row.media_sha256 == hashlib.sha256(media_chunks.wav(raw)).hexdigest() and row.media_bytes == len(raw) + 44


def test_gear_hash_sees_the_last_32_bytes():
    data = np.random.default_rng(0).integers(0, 256, 500, dtype=np.uint8)
    h = media_chunks.gear_hash(data)
    for at in (0, 5, 31, 32, 499):
        x = 0
        for b in data[max(0, at - 31) : at + 1]:
            x = ((x << 1) + int(media_chunks._GEAR[b])) & 0xFFFFFFFF
        assert x == h[at]


TURNS = [(1, 0, "system", "### hi </turn>\n"), (1, 1, "user", "\\h\\e\\b"), (1, 2, "assistant", "</turn>\n### assistant\nx"), (1, 3, "assistant", ""), (2, 0, "us\ner###", "no reply"), (3, 0, "assistant", "é東\n")]


def test_chat_round_trip_and_examples(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_conversations(turns)
    back = sorted((r.conv_id, r.turn_no, r.role, r.text) for r in chat_format.read_turns(formatted).collect())
    assert back == TURNS
    whole = {r.conv_id: r.transcript for r in formatted.collect()}
    ex = sorted(chat_format.with_contexts(formatted).collect(), key=lambda r: (r.conv_id, r.turn_no))
    assert [(r.conv_id, r.turn_no) for r in ex] == [(1, 2), (1, 3), (3, 0)]
    for r in ex:
        assert len(r.context) == r.context_chars and whole[r.conv_id].startswith(r.context + r.target + chat_format.CLOSE)
        assert r.context.endswith("### assistant\n")
    got = {r.conv_id: r for r in chat_format.digests(formatted).collect()}
    loss = "</turn>\n### assistant\nx"
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (4, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for c, _, r, t in TURNS if c == 1).encode()).hexdigest()
    assert got[2].loss_chars == 0 and got[2].loss_sha256 == hashlib.sha256(b"").hexdigest()


def test_chat_digests_come_from_the_expanded_examples(spark, monkeypatch):
    """The loss and the length are those of the examples; a context that misses its target fails."""
    turns = spark.createDataFrame([*TURNS, (None, 0, "assistant", "### assistant\n"), (None, 1, "x", "### assistant\n"), (4, 0, "user", "")], "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_conversations(turns)
    got = {r.conv_id: r for r in chat_format.digests(formatted).collect()}
    whole = {r.conv_id: r.transcript for r in formatted.collect()}
    assert {c: r.formatted_chars for c, r in got.items()} == {c: len(x) for c, x in whole.items()}
    targets: dict = {c: "" for c in whole}
    for r in sorted(chat_format.with_contexts(formatted).collect(), key=lambda r: r.turn_no):
        assert whole[r.conv_id][: r.context_chars] == r.context
        targets[r.conv_id] += r.target.replace("\\h", "### ").replace("\\e", "</turn>").replace("\\b", "\\")
    assert {c: r.loss_sha256 for c, r in got.items()} == {c: hashlib.sha256(x.encode()).hexdigest() for c, x in targets.items()}
    expand = chat_format.examples
    for name, wrong in (("context_chars", "context_chars + 1"), ("target", "concat(target, 'x')")):
        monkeypatch.setattr(chat_format, "examples", lambda f, name=name, wrong=wrong: expand(f).withColumn(name, F.expr(wrong)))
        with pytest.raises(Exception, match="does not end at its target"):
            chat_format.digests(formatted).collect()
    monkeypatch.setattr(chat_format, "examples", lambda f: expand(f).where("turn_no <> 2"))
    with pytest.raises(Exception, match="does not end at its target"):
        chat_format.digests(formatted).collect()


def test_warc_derivatives_carry_the_source_through(spark):
    head = "HTTP/1.1 203 Fine\r\nServer: x:1\r\nEtag:none"
    given = (1, "http://e/1", "<p>One</p>", "<urn:uuid:a>", "2020-02-02T02:02:02Z", head, "sha1:P", "sha1:B")
    pages = spark.createDataFrame([given, (2, "http://e/2", "", None, None, None, None, None)], "page_id long, url string, html string, " + ", ".join(f"{c} string" for c in warc.SOURCE))
    out = warc.derivatives(pages, responses=True).toPandas().set_index(["page_id", "record_type"])
    for kind in ("metadata", "conversion"):
        by = dict(warc.parse(out.record[1, kind])[0])
        assert by["WARC-Refers-To"] == "<urn:uuid:a>" and by["WARC-Date"] == "2020-02-02T02:02:02Z"
        assert out.source_headers[1, kind] == "Server: x:1\nEtag: none" and out.payload_digest[1, kind] == "sha1:P"
    fields = warc.parse(out.record[1, "metadata"])[1].decode()
    assert all(f"source-{x}\r\n" in fields for x in ("record-id: <urn:uuid:a>", "payload-digest: sha1:P", "block-digest: sha1:B", "header-server: x:1", "header-etag: none"))
    assert warc.parse(out.record[1, "response"])[1].decode() == head + "\r\n\r\n<p>One</p>"
    plain = warc.derivatives(pages.select("page_id", "url", "html"), responses=True).toPandas().set_index(["page_id", "record_type"])
    assert plain.loc[2].equals(out.loc[2])


def test_warc_records_parse_back_and_link(spark):
    page = '<!doctype html><html lang="en"><head><meta charset="utf-8"><title>A &amp; B</title><style>p{}</style></head><body><p>One</p><!-- no --><div>Two &lt;3</div><a href="/x?a=1&amp;b=2">l</a><script>var t="</p>";</script></body></html>'
    rows = warc.derivatives(spark.createDataFrame([(1, "http://e/1", page)], "page_id long, url string, html string"), responses=True).toPandas().set_index("record_type")
    source = dict(warc.parse(rows.record["response"])[0])
    for kind in ("metadata", "conversion"):
        headers, block = warc.parse(rows.record[kind])
        by = dict(headers)
        assert by["WARC-Refers-To"] == source["WARC-Record-ID"] == rows.refers_to[kind] and by["WARC-Target-URI"] == "http://e/1"
        assert len(block) == rows.content_length[kind] and by["WARC-Block-Digest"] == rows.block_digest[kind]
    assert warc.parse(rows.record["conversion"])[1].decode() == "One\nTwo <3\nl"
    fields = warc.parse(rows.record["metadata"])[1].decode().split("\r\n")
    assert {"title: A & B", "language: en", "charset: utf-8", "outlink: /x?a=1&b=2", f"source-payload-digest: {source['WARC-Payload-Digest']}"} <= set(fields)
    assert source["WARC-Payload-Digest"] == warc.sha256_label(page.encode())
    with pytest.raises(ValueError):
        warc.parse(rows.record["metadata"].replace(b"title", b"titel"))


def test_token_spans_match_an_offset_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(token_counts.VOCABULARY.replace(".tiktoken", ".json"))
    reference.encode_special_tokens = True
    vocabulary = open(token_counts.VOCABULARY, "rb").read()
    for text in ("Hello  world\n\nfoo 123", "größer ñandú 東京 🙂!", "a\tb  \n c", "<|endoftext|> x"):
        want = reference.encode(text, add_special_tokens=False)
        start, end = token_counts.token_spans(text, vocabulary)
        assert len(want.ids) == len(start) and start[0] == 0 and end[-1] == len(text) and (start[1:] <= end[:-1]).all()
        # tokens that end and begin at whole characters say what the tokenizer says
        encoder, _ = token_counts._encoder(vocabulary)
        assert encoder.encode_ordinary(text) == want.ids
        at = 0
        raw = text.encode()
        for i, (a, b) in zip(want.ids, zip(start.tolist(), end.tolist(), strict=True), strict=True):
            piece = encoder.decode_single_token_bytes(i)
            assert raw[at : at + len(piece)] == piece and len(raw[:at].decode(errors="ignore")) == a
            at += len(piece)
            assert b == len((raw[:at] + b"").decode(errors="ignore")) + (0 if _whole(raw[:at]) else 1)


def _whole(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def test_attribution_rules():
    start, end = np.array([0, 2, 5, 8]), np.array([2, 5, 8, 9])
    sections = [("a", 0, 3), ("b", 3, 7)]
    at = lambda rule: token_counts.attribute(start, end, sections, rule)
    assert at("start") == {"a": 2, "b": 1, None: 1}
    assert at("end") == {"a": 1, "b": 1, None: 2}
    assert at("majority") == {"a": 1, "b": 2, None: 1}
    split = at("split")
    assert split["a"] == pytest.approx(4 / 3) and split["b"] == pytest.approx(2 / 3 + 2 / 3) and split[None] == pytest.approx(4 / 3)


def head_body_tail(text: str) -> list[tuple[str, int, int]]:
    """Lines of a text by hand."""
    first = text.find("\n") + 1
    if not first:
        return [("head", 0, len(text))] if text else []
    last = text.rfind("\n", 0, len(text) - 1) + 1
    if last <= first:
        return [("head", 0, first)] + ([("tail", first, len(text))] if first < len(text) else [])
    return [("head", 0, first), ("body", first, last), ("tail", last, len(text))]


def tokens_by_hand(text: str, sections: list, rule: str, vocabulary: bytes) -> dict:
    """Character by character: which section holds each of a token's characters."""
    owner = [next((n for n, a, b in sections if a <= i < b), None) for i in range(len(text))]
    out: dict = {n: 0.0 for n, _, _ in sections}
    for a, b in zip(*token_counts.token_spans(text, vocabulary), strict=True):
        held = owner[a:b]
        if rule == "majority":
            best = max(dict.fromkeys(held), key=lambda n: (held.count(n), -held.index(n) if n is not None else -len(held)))
            shares = {best: 1.0}
        else:
            shares = {n: held.count(n) / len(held) for n in dict.fromkeys(held)}
        for n, x in shares.items():
            out[n] = out.get(n, 0.0) + x
    return out


def test_token_attribution_matches_characters(spark):
    rng = random.Random(3)
    texts = ["", "one line", "a\n", "\n", "a\nb", "a\nb\n", "head ñandú\nbody 東京 body\n\ntail 🙂", "\n\n\n"]
    texts += ["".join(rng.choice(["word ", "x", "\n", "東", "  ", "1234", "é"]) for _ in range(rng.randint(0, 80))) for _ in range(60)]
    vocabulary = open(token_counts.VOCABULARY, "rb").read()
    docs = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string")
    table = [(i, f"s{k}", a, a + rng.randint(0, 6)) for i, t in enumerate(texts) for k, a in enumerate(range(rng.randint(0, 3), len(t), 9))]
    for given in (None, spark.createDataFrame(table, "doc_id long, section string, lo long, hi long")):
        got = token_counts.token_attribution(docs, given).toPandas()
        for i, t in enumerate(texts):
            parts = head_body_tail(t) if given is None else [(n, a, min(b, len(t))) for d, n, a, b in table if d == i]
            own = got[got.doc_id == i]
            rows = {(r.section if isinstance(r.section, str) else None): r for r in own.itertuples()}
            for column, rule in (("n_tokens", "majority"), ("split_tokens", "split")):
                want = tokens_by_hand(t, parts, rule, vocabulary)
                assert {n: pytest.approx(x) for n, x in want.items() if x} == {n: getattr(r, column) for n, r in rows.items() if getattr(r, column)}, (t, parts)
            assert all(r.n_chars == sum(b - a for n, a, b in parts if n == name) for name, r in rows.items() if name)
    overlapping = spark.createDataFrame([(1, "a", 0, 5), (1, "b", 3, 7)], "doc_id long, section string, lo long, hi long")
    with pytest.raises(Exception, match="overlap"):
        token_counts.token_attribution(docs, overlapping).collect()


def test_toxicity_training_and_scores_match_a_plain_version():
    """FTRL-proximal, one coordinate and one example after the other."""
    rng = random.Random(6)
    p = toxicity.FtrlParams(bits=12, l1=0.4, epochs=3)
    texts = [" ".join(rng.choice(["bad", "worse", "fine", "ok", "so", "it", "goes"]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    y = np.array([float("bad" in t) for t in texts])

    def features(text: str) -> dict[int, float]:
        w = text.split()
        h = {x: int(words(*flat([x]), ALNUM).hash[0]) for x in w}
        out = {h[x] >> (64 - p.bits) & ~1: 1.0 for x in w}
        for gap in (1, 2, 3):
            for a, b in zip(w, w[gap:]):
                pair = words(*flat([f"{a} {b}" if gap == 1 else f"{a} " + "z " * (gap - 1) + b]), ALNUM)
                out[int(ngrams(pair, 2, (0, gap))[0][0]) >> (64 - p.bits) | 1] = p.gram_value
        return out

    rows, feats = toxicity._distinct(*toxicity.hashed_features(*flat(texts), p.bits), p.bits)
    examples = [feats[rows == i] for i in range(len(texts))]
    assert [sorted(e.tolist()) for e in examples] == [sorted(features(t)) for t in texts]
    z, n = {}, {}
    odds = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))

    def weight(i) -> float:
        l1 = 0.0 if i == "bias" else p.l1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for t, target in zip(texts, y, strict=True):
            x = {**features(t), "bias": 1.0}
            score = 1 / (1 + np.exp(-(sum(weight(i) * v for i, v in x.items()) + odds)))
            steps = {i: ((score - target) * v, weight(i)) for i, v in x.items()}
            for i, (g, w) in steps.items():
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (np.sqrt(n[i]) - np.sqrt(before)) / p.alpha * w
    got, bias = toxicity.ftrl_train(examples, y, p)
    assert bias == pytest.approx(weight("bias") + odds)
    for i in set(z) - {"bias"}:
        assert got[i] == pytest.approx(weight(i) * (p.gram_value if i & 1 else 1.0), abs=1e-9)
    assert 0 < np.count_nonzero(got) < len(z) - 1
    model = toxicity.SparseWeights(np.flatnonzero(got), got[got != 0], bias, p.bits)
    scores = toxicity._scores(*flat(texts), model.dense(), model)
    for t, s in zip(texts, scores, strict=True):
        assert s == pytest.approx(1 / (1 + np.exp(-(sum(got[i] for i in features(t)) + bias))), abs=1e-6)


def test_quality_scores_match_a_plain_forward_pass():
    """Passages, gated attention and the score of every document, one passage after the other."""
    p = quality.MilParams(passage_words=4, hidden=3, attention=2, projected=5)
    rng = np.random.default_rng(4)
    theta = quality.init_params(p) + rng.normal(size=quality.init_params(p).shape) * 0.3
    texts = ["one two three FOUR five! six 7 eight nine", "", "x", "a a a a a a a a a a", "größer ñandú 東京\n| b"]
    w1, b1, v, u, wa, c, b = quality._unpack(theta, p)
    got = quality._scores(*flat(texts), theta, p)
    row, x = quality.encode_passages(*flat(texts), p)
    assert [int((row == i).sum()) for i in range(len(texts))] == [-(-len(t.split()) // 4) for t in texts]
    for i in range(len(texts)):
        h = [np.tanh(f @ w1 + b1) for f in x[row == i].astype(float)]
        e = [float(wa @ (np.tanh(k @ v) / (1 + np.exp(-(k @ u))))) for k in h]
        a = np.exp(e) / np.exp(e).sum() if h else []
        z = sum((k * y for k, y in zip(a, h, strict=True)), np.zeros(p.hidden))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(z @ c + b[0]))))
    alone = [quality.encode_passages(*flat([t]), p)[1] for t in texts]
    assert np.allclose(np.concatenate(alone), x)  # a passage's features don't depend on its slice


def labelled(spark, n: int, make):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        y = rng.random() < 0.3
        rows.append((i, make(rng, y)))
        labels.append((i, int(y), int(y)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: y for i, y, _ in labels}


def test_toxicity_held_out_accuracy_and_sparsity(spark):
    def make(rng, y):
        w = [f"n{rng.randint(0, 500)}" for _ in range(rng.randint(20, 200))]
        if y:
            w.insert(rng.randint(0, len(w)), rng.choice(["awful", "nasty", "vile"]))
        return " ".join(w)

    docs, labels, truth = labelled(spark, 1500, make)
    got = toxicity.toxicity_scores(docs, labels).toPandas()
    held = got[got.held_out]
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out, strict=True))
    assert (held.predicted == held.doc_id.map(truth)).mean() > 0.97 and got.score.between(0, 1).all()
    model = toxicity.train_toxicity(docs, labels, toxicity.fold_of("doc_id", 5) != 0)
    assert len(model.index) < 2000


def test_quality_held_out_accuracy(spark):
    def make(rng, y):
        w = [f"word{rng.randint(0, 5000)}" for _ in range(rng.randint(5, 300))]
        return " ".join(w if y else [x.upper() + "!!" for x in w])

    docs, labels, truth = labelled(spark, 900, make)
    got = quality.quality_scores(docs, labels).toPandas()
    held = got[got.held_out]
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got.doc_id, got.held_out, strict=True))
    assert (held.predicted == held.doc_id.map(truth)).mean() > 0.98


def test_quality_gradient_matches_differences():
    p = quality.MilParams(hidden=4, attention=3, projected=2)
    rng = np.random.default_rng(0)
    x, bag, y = rng.normal(size=(9, quality._shapes(p)[0][0])), np.array([0, 0, 0, 1, 1, 2, 2, 2, 2]), np.array([1.0, 0.0, 1.0])
    theta = quality.init_params(p) + rng.normal(size=quality.init_params(p).shape) * 0.1

    def loss(t):
        z = quality.forward(t, x, bag, 3, p)[0]
        return np.mean(np.logaddexp(0, z) - y * z) + p.decay * (t @ t) / 2

    g = quality.gradient(theta, x, bag, y, p)
    for i in range(0, len(theta), 7):
        d = np.zeros_like(theta)
        d[i] = 1e-5
        assert g[i] == pytest.approx((loss(theta + d) - loss(theta - d)) / 2e-5, abs=1e-6)


def test_attention_weights_sum_to_one(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(500))), (2, "a b")], "doc_id long, text string")
    got = quality.passage_attention(docs, quality.init_params(quality.MilParams())).toPandas()
    assert np.allclose(got.groupby("doc_id").weight.sum(), 1) and (got.doc_id == 1).sum() == -(-500 // 48)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r.node: r.comp for r in common.connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[100] == got[101] == 100


def test_token_spans_of_long_white_space():
    """Runs are cut where the pattern cuts: token by token what short runs give, whatever stands behind them."""
    with open(token_counts.VOCABULARY, "rb") as f:
        vocabulary = f.read()
    encoder, _ = token_counts._encoder(vocabulary)
    for c in (" ", "\n", "\t", "\u3000"):
        for behind in ("", "b", "1", "!", " b", "\nb"):
            text = "a" + c * 1_300 + behind
            assert [i for part in token_counts._encoded(text, encoder) for i in part] == encoder.encode_ordinary(text)
    for c, n in ((" ", 1_000_000), (" ", 20_000_000), ("\n", 1_000_000), ("\t", 1_000_000)):
        start, end = token_counts.token_spans("a" + c * n + "b", vocabulary)
        assert start[0] == 0 and end[-1] == n + 2 and (start[1:] <= end[:-1]).all() and len(start) > n // 8


def test_token_counts_of_junk_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a" + " " * 1_000_000 + "b"), (2, " " * 700_000), (3, "\n" * 700_000), (4, None)], "doc_id long, text string")
    got = token_counts.token_attribution(docs).groupBy("doc_id").agg(F.sum("n_chars").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {1: 1_000_002, 2: 700_000, 3: 700_000}
    table = spark.createDataFrame([(1, "s", 0, 5)], "doc_id long, section string, lo long, hi long")
    assert token_counts.with_sections(docs.withColumn("sections", F.lit(1)), table).columns == ["doc_id", "text", "sections"]


def test_a_million_equal_rows_are_mixed(spark):
    """They are one member of a block, and their copies are made in many places."""
    docs = spark.range(1_000_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit("x y").alias("text"))
    docs = docs.union(spark.createDataFrame([(2, "b", "z"), (3, "b", "u v w")], docs.schema))
    mixed = mixing.mix_sources(docs)
    one = mixed.agg(F.count("*"), F.sum("taken"), F.max(F.col("taken") - 2 * F.col("size"))).first()
    assert one[0] == 1_000_002 and one[2] <= 0
    hot = mixed.where("doc_id = 1").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(hot) > 1 and sum(r["count"] for r in hot) == 1_000_000
    assert mixing.repeat_mixed(docs).where("doc_id = 1").agg(F.max("copy"), F.count("*")).first() == mixed.where("doc_id = 1").agg(F.sum("copies"), F.sum("copies")).first()
