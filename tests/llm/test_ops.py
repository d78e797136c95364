"""Each operator against a brute-force version, over nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scriptora.llm import bpe, decontaminate, language_id, licenses, lm, quality, secrets, sharding, simhash, suffixes, toxicity
from scriptora.llm.common import LOWER_BYTES, remainder

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOW))


def spaced(t):
    return (t or "").encode().translate(LOWER_BYTES).split()


# --- 1


def hits(text, items, width=8):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        iw = words(t)
        for k in range(max(1, len(iw) - width + 1)) if iw else []:
            win = iw[k : k + width]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.fixture(scope="module")
def items(spark, rows):
    texts = [(9, rows[40][1][:200]), (10, rows[40][1][30:260]), (11, "Gamma, the"), (12, None), (13, ""), (9, "no such words at all")]
    return texts, spark.createDataFrame(texts, "item_id long, text string")


@pytest.mark.parametrize("block", [None, 400])
def test_contamination(docs, rows, items, block, monkeypatch):
    if block:
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in decontaminate.contamination(docs, items[1]).collect())
    want = []
    for r in rows:
        n, h, f = hits(r[1], items[0])
        want.append((r[0] or -1 if r[0] is None else r[0] or -1, n, h, tuple(f), len(f) >= 2))
    assert got == sorted(want)
    assert any(x[4] for x in got) and not all(x[4] for x in got)


def test_windows_that_all_items_share(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS_A_ROW", 7)
    head = "all items begin with these same eight words"
    texts = [(i, f"{head} item{i}") for i in range(60)] + [(3, f"{head} item3")]
    got = decontaminate.contamination(
        spark.createDataFrame([(1, "x " + head), (2, f"{head} item5"), (3, "none")], "doc_id long, text string"), spark.createDataFrame(texts, "item_id long, text string")
    ).collect()
    got = {r.doc_id: (r.n_hit, r.n_items, len(r.item_ids)) for r in got}
    assert got == {1: (8, 60, 60), 2: (9, 60, 60), 3: (0, 0, 0)}
    rows = decontaminate.item_windows(spark.createDataFrame(texts, "item_id long, text string")).collect()
    assert max(len(r.item_ids) for r in rows) <= 20 and sum(len(r.item_ids) for r in rows if r.key == head) == 60


def test_contamination_of_nothing(docs, empty, items, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(empty, items[1]).count() == 0
    assert decontaminate.contamination(docs, none).where("n_items > 0").count() == 0
    assert decontaminate.clean(docs, none).count() == docs.count()
    assert decontaminate.clean(docs, items[1]).columns == docs.columns


# --- 2


def fingerprint(t):
    w = spaced(t)
    sh = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    c = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            c[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * c[b] > len(sh))


def test_near_duplicates(docs, rows):
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.fp & (2**64 - 1), r.n_near, r.component_id) for r in simhash.near_duplicates(docs).collect())
    fp = [fingerprint(r[1]) for r in rows]
    near = [[j for j in range(len(fp)) if j != i and (fp[i] ^ fp[j]).bit_count() <= 3] for i in range(len(fp))]
    comp = list(range(len(fp)))
    for _ in fp:
        comp = [min([comp[i], *(comp[j] for j in near[i])]) for i in range(len(fp))]
    ids = [r[0] for r in rows]
    least = {c: min((ids[i] for i in range(len(ids)) if comp[i] == c and ids[i] is not None), default=None) for c in comp}
    want = sorted((-1 if ids[i] is None else ids[i], fp[i], len(near[i]), least[comp[i]]) for i in range(len(ids)))
    assert got == want
    assert max(x[2] for x in got) >= 2  # three equal texts


def test_one_of_each(docs, empty):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    of = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    # one row of each class of those with an id, and the text without an id, which is near no other
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({c for c in of.values() if c is not None})
    assert [r.text for r in kept.where("doc_id is null").collect()] == ["Null id text here"]
    assert simhash.one_of_each(empty).count() == 0


def test_one_of_each_of_equal_ids_and_clashing_names(spark):
    a, b = "one two three four five six seven", "eins zwei drei vier fünf sechs sieben acht"
    rows = [(5, a, "x", 1, 2, 3), (5, b, "x", 1, 2, 3), (5, a, "y", 1, 2, 3), (5, a, "y", 1, 2, 3), (9, b, "z", 1, 2, 3), (None, "", "n", 1, 2, 3), (None, None, "n", 1, 2, 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, own_id string, text_hash int, nth int, __id int").repartition(3)
    got = simhash.one_of_each(d)
    assert got.columns == d.columns
    out = got.collect()
    assert sorted((r.doc_id, r.text) for r in out if r.doc_id is not None) == [(5, b), (5, a)] and len(out) == 3
    assert all((r.text_hash, r.nth, r["__id"]) == (1, 2, 3) for r in out) and {r.own_id for r in out} <= {"x", "y", "n"}


def test_bit_planes_agree_with_popcount():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.array([np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, k, dtype=np.uint64)) if k else np.uint64(0) for k in rng.integers(0, 6, 300)], dtype=np.uint64)
    fps = base[rng.integers(0, 40, 300)] ^ flips
    for radius in (0, 1, 2, 3):
        i, j = simhash.near_pairs(fps, fps, radius)
        want = {(a, b) for a in range(300) for b in range(300) if int(fps[a] ^ fps[b]).bit_count() <= radius}
        assert set(zip(i.tolist(), j.tolist())) == want


@pytest.mark.parametrize("tile", [2, 3, 2048])
def test_hot_buckets_are_tiled(spark, tile):
    rng = np.random.default_rng(2)
    fps = list({int(x) for x in (np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 12, 60, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 12, 60, dtype=np.uint64)))})
    d = spark.createDataFrame([(f, 1 + f % 3) for f in fps], "fp long, n long")
    got = {r.fp: r.near for r in simhash.links(d, tile).groupBy("fp").agg(F.sum("near").alias("near")).collect()}
    want = {a: sum(1 + b % 3 for b in fps if a != b and (a ^ b).bit_count() <= 3) for a in fps}
    assert got == {k: v for k, v in want.items() if v}


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 100), (200, 150), (150, 150)], "u long, v long")
    got = {r.u: r.root for r in simhash.components(e).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, 200: 150}


# --- 3


def vocabulary():
    import public_tokenizers as p

    return p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN


def test_bpe_is_the_library_s(docs, rows, empty):
    path, pattern = vocabulary()
    enc = bpe.encoding(path, pattern)
    out = bpe.decode(bpe.encode(docs, path, pattern), path, pattern)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, bytes(r.token_ids), bytes(r.decoded)) for r in out.collect())
    want = []
    for r in rows:
        ids = enc.encode_ordinary(r[1] or "")
        want.append((-1 if r[0] is None else r[0], len(ids), np.array(ids, dtype="<u4").tobytes(), (r[1] or "").encode()))
    assert got == sorted(want)
    assert bpe.decode(bpe.encode(empty, path, pattern), path, pattern).count() == 0


def test_bpe_joins_at_any_place():
    import random

    enc = bpe.encoding(*vocabulary())
    rng = random.Random(4)
    bits = ["a", "B", "é", " ", "  ", "\n", "　", "'s", "'", "12", "!?", "\x1c", "\x85", " word", "日本", "​", "\r\n"]
    for _ in range(2000):
        s = "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))
        ids = bpe.encode_text(enc, s, leaf=rng.choice([1, 2, 5, 17]))
        assert ids == enc.encode_ordinary(s)
        assert bpe.decode_ids(enc, ids, leaf=3) == s.encode()


# --- 4


def base(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = list(zip(w, w[1:], w[2:]))
    c, pos = Counter(win), set()
    for k, x in enumerate(win):
        if c[x] > 1:
            pos |= {k, k + 1, k + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(pos), len(w) < 50 or 100 * len(pos) > 50 * len(w)


def test_quality_base(docs, rows, empty):
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = sorted((-1 if r.doc_id is None else r.doc_id, *[r[c] for c in cols]) for r in quality.verdicts(docs).collect())
    assert got == sorted((-1 if r[0] is None else r[0], *base(r[1])) for r in rows)
    assert quality.verdicts(empty).count() == 0


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    import random

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(60, 400))), "en", "a") for i in range(400)]
    rows += [(1000 + i, " ".join(word() + "###" for _ in range(200)), "en", "a") for i in range(20)]
    rows += [(2000, " ".join(word() for _ in range(20000)), "en", "a"), (2001, " ".join(word() for _ in range(80)), "xx", "b")]
    got = {r.doc_id: r.kept for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [k for k, v in got.items() if not v] == [] or all(k // 1000 == 1 for k, v in got.items() if not v)
    assert sum(not v for v in got.values()) == 20


def test_quality_rejects_for_repeated_lines_or_words_alone(spark):
    import random

    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, "\n".join(some(10) for _ in range(rng.randint(6, 40))), "en", "a") for i in range(400)]
    # a short line again and again between long ones, but no 3 words twice
    rows += [(1000 + i, "\n".join(some(3) + "\nabcd" for _ in range(80)), "en", "a") for i in range(10)]
    # one phrase again and again, but no line twice
    rows += [(2000 + i, some(170) + (" " + some(20)) * 7, "en", "a") for i in range(10)]
    out = quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert not any(r.base_failed for r in out)
    assert all(r.n_repeat_words == 0 for r in out if r.doc_id // 1000 == 1) and all(r.n_dup_lines == 0 for r in out if r.doc_id >= 2000)
    assert {r.doc_id for r in out if not r.kept} == {r[0] for r in rows if r[0] >= 1000}


def robust(X):
    """Scaled squared distances by the covariance of the least determinant, in NumPy."""
    floor, best = np.diag(np.square(quality.FLOOR)), None
    at = lambda q: np.sort(X, 0)[np.maximum(np.ceil(q * len(X)).astype(int) - 1, 0)]
    spread = np.maximum(quality.FLOOR, (at(0.75) - at(0.25)) / 1.349)
    far = lambda m, S: np.einsum("ij,jk,ik->i", X - m, np.linalg.inv(S), X - m)
    for m, S in ((at(0.5), floor), (at(0.5), np.diag(spread**2)), (X.mean(0), np.cov(X.T, bias=True) + floor)):
        before = np.inf
        for _ in range(quality.STEPS):
            d = far(m, S)
            near = X[d <= np.sort(d)[int(np.ceil(quality.SUPPORT * len(X))) - 1]]
            m, S = near.mean(0), np.cov(near.T, bias=True) + floor
            det = np.linalg.slogdet(S)[1]
            best = (det, m, S) if best is None or det < best[0] - 1e-12 else best
            if before - det < 1e-9:
                break
            before = det
    d = far(*best[1:])
    return d * min(1, quality.CHI2_MEDIAN / np.sort(d)[int(np.ceil(len(d) / 2)) - 1])


def test_quality_is_what_numpy_gives(spark, monkeypatch):
    import random

    monkeypatch.setattr(quality, "SETTLED", 1e-9)
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(1, 11))) + rng.choice(["", "", "", "#", "##"])
    some = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for i in range(240):
        lines = [some(rng.randint(5, 12)) for _ in range(rng.randint(20, 40))]
        lines += rng.choices(lines, k=rng.choice([0, 0, 0, 1, 3, 9]))
        rows.append((i, "\n".join(lines), rng.choice(["en", "de"]), "s"))
    out = quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    verdicts = set()
    for lang in ("en", "de"):
        mine = [r for r in out if r.g0 == lang and not r.base_failed]
        assert len(mine) > 80
        want = robust(np.array([[r[x] for x in quality.DIMS] for r in mine]))
        assert [r.distance for r in mine] == pytest.approx(want.tolist(), rel=1e-6)
        assert [r.kept for r in mine] == (want <= quality.CUTOFF).tolist()
        verdicts |= {r.kept for r in mine}
    assert verdicts == {True, False}


def test_quality_judges_small_groups(spark):
    import random

    rng = random.Random(11)
    word = lambda end="": "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) + end
    text = lambda end="": " ".join(word(end) for _ in range(rng.randint(60, 300)))
    rows = [(i, text(), "en", "a") for i in range(200)]
    rows += [(1000 + i, text(), "xx", f"s{i % 5}") for i in range(95)]  # few of each source, enough of the language
    rows += [(2000 + i, text(), None, "a") for i in range(9)]  # few of the language, too
    bad = [(3000 + i, text("###"), "xx", f"s{i}") for i in range(5)] + [(3100, text("###"), None, "a"), (3101, text("###"), "yy", None)]
    rows += [*bad, (4000, "too short", "zz", "b")]  # no row of zz passes the base rule
    got = {r.doc_id: r for r in quality.verdicts(spark.createDataFrame(rows + bad[:1], "doc_id long, text string, lang string, source string")).collect()}
    assert {k for k, r in got.items() if not r.kept} == {r[0] for r in bad} | {4000}
    assert all(r.distance is not None for r in got.values())
    few = quality.verdicts(spark.createDataFrame(rows[:1] + bad[:1] + rows[2:8], "doc_id long, text string, lang string, source string")).collect()
    assert [r.doc_id for r in few if not r.kept] == [3000]


# --- 5


@pytest.mark.parametrize("limit", [100, 1000, 10**9])
def test_shards_fit(docs, rows, limit):
    out = sharding.assign(docs, limit).select("doc_id", "text", "n_bytes", "shard", "depth").collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.n_bytes)
    assert all(sum(v) <= limit or len(v) == 1 for v in by.values())
    names = [s for s in by if "-" not in s]
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    if limit == 10**9:
        assert set(by) == {""}


def by_hand(rows, limit):
    """The bucket of each (60-bit hash, bytes): the shortest prefix whose rows fit the limit, or all bits."""
    total = Counter()
    for h, n in rows:
        for d in range(61):
            total[d, h >> (60 - d)] += n
    out = []
    for h, _ in rows:
        d = next((d for d in range(61) if total[d, h >> (60 - d)] <= limit), 60)
        out.append(format(h, "060b")[:d])
    return out


@pytest.mark.parametrize("limit", [300, 2000, 100000])
def test_shards_are_the_shortest_prefixes(spark, limit):
    import random

    rng = random.Random(12)
    data = [(i, "x" * rng.randint(0, 150), 1, 2, 3) for i in range(500)]
    d = spark.createDataFrame(data, "doc_id long, text string, h int, b int, `__h` int").repartition(3)
    out = sharding.assign(d, limit)
    assert out.columns == [*d.columns, "n_bytes", "depth", "shard"]
    h = d.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), "text"), 4).alias("k"), F.octet_length("text").alias("n")).collect()
    want = dict(zip((r.doc_id for r in h), by_hand([(r.k, r.n) for r in h], limit)))
    got = out.collect()
    assert {r.doc_id: r.shard for r in got} == want
    assert all((r.h, r.b, r["__h"]) == (1, 2, 3) and r.depth == len(r.shard) for r in got)


def test_repeated_rows_are_packed(spark, empty):
    d = spark.createDataFrame([(1, "x" * 10)] * 95, "doc_id long, text string")
    by = Counter(r.shard for r in sharding.assign(d, 50).collect())
    assert max(by.values()) <= 5 and sum(by.values()) == 95
    assert sharding.assign(empty, 10).count() == 0


# --- 6


def test_language_id(spark, empty):
    import random

    rng = random.Random(3)
    langs = {"aa": ["the", "and", "ing", "th"], "bb": ["der", "ung", "sch", "ö"]}
    text = lambda k: " ".join("".join(rng.choice(langs[k]) for _ in range(3)) for _ in range(30))
    rows = [(i, text("aa" if i % 2 else "bb"), "aa" if i % 2 else "bb") for i in range(300)] + [(900, None, "aa"), (901, "12 !?", None), (902, "", "bb")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(language_id.training_rows(d, remainder(F.col("doc_id"), 4) != 2))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(d, model).collect()}
    assert all(got[i][0] == lang and 0 < got[i][1] <= 1 for i, _, lang in rows[:300])
    assert [got[k] for k in (900, 901, 902)] == [("und", 0.0)] * 3
    kept = language_id.identified(d, model, 0.3)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == set(range(300))
    assert language_id.fit(language_id.training_rows(empty, F.lit(True))) is None
    assert {r.lang_pred for r in language_id.predict(d, None).collect()} == {"und"}


def plain_cells(text):
    """The cells of a text's n-grams, by plain integers."""
    cp, out = [ord(c) for c in text.lower()], []
    for n in range(1, language_id.ORDERS + 1):
        for k in range(len(cp) - n + 1):
            h = 0
            for m in range(n):
                h = ((h * 0x9E3779B97F4A7C15) ^ (cp[k + m] + m + 1)) % 2**64
            out.append((h * 0xD6E8FEB86659FD93) % 2**64 >> 48)
    return out


def test_language_id_is_what_plain_sums_give(spark):
    import random

    rng = random.Random(16)
    bits = {"aa": ["the", "and", "ing", "th"], "bb": ["der", "ung", "sch", "ö"], "cc": ["日", "本", "語 "]}
    text = lambda k, n=20: " ".join("".join(rng.choice(bits[k]) for _ in range(3)) for _ in range(n))
    rows = [(text(k), k) for k in bits for _ in range(40)]
    d = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    model = language_id.fit(d)
    total, df = language_id.document_frequency(d)
    want = np.zeros(language_id.FEATURES)
    for t, _ in rows:
        want[list(set(plain_cells(t)))] += 1
    assert total == len(rows) and (df == want).all()
    idf = np.log((1 + total) / (1 + want)) + 1
    weights = model["table"][:, :-1] / (idf[:, None] * language_id.SCALE)
    odd = ["Der the 日本", "a", "é!", text("aa", 3000), "日" * 400]
    for t in [text(k, 5) for k in bits] + odd:
        tf = Counter(plain_cells(t))
        x = {c: n * idf[c] for c, n in tf.items()}
        s = np.array([sum(language_id.SCALE * v / sum(x.values()) * weights[c, k] for c, v in x.items()) + model["bias"][k] for k in range(3)]) / model["temperature"]
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        name, score = language_id.classify(t, model)
        assert name == model["names"][int(p.argmax())] and score == pytest.approx(p.max(), rel=1e-3)


def test_ftrl_is_the_plain_rule():
    from scriptora.llm.ftrl import Ftrl

    rng = np.random.default_rng(3)
    m, z, n = Ftrl(1, 5, alpha=0.2, l1=0.3, l2=0.5), [0.0] * 6, [0.0] * 6
    w = lambda i: 0.0 if abs(z[i]) <= 0.3 else -(z[i] - math.copysign(0.3, z[i])) / ((1 + math.sqrt(n[i])) / 0.2 + 0.5)
    for _ in range(300):
        at, y = np.append(rng.choice(5, 2, replace=False), 5), rng.integers(0, 2)
        s = sum(w(i) for i in at)
        assert m.scores(at, np.ones(3))[0] == pytest.approx(s, abs=1e-9)
        g = 1 / (1 + math.exp(-s)) - y
        for i in at:
            step = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.2
            z[i] += g - step * w(i)
            n[i] += g * g
        m.step(at, np.ones(3), np.array([g]))


def test_languages_of_many_copies_are_learned(spark, monkeypatch):
    import random

    steps, step = [], language_id.Ftrl.step
    monkeypatch.setattr(language_id.Ftrl, "step", lambda *a: (steps.append(1), step(*a)))

    rng = random.Random(12)
    text = lambda bits: " ".join("".join(rng.choice(bits) for _ in range(3)) for _ in range(30))
    aa, bb = ["the", "and", "ing", "th"], ["der", "ung", "sch", "ö"]
    rows = [(text(aa), "aa") for _ in range(60)] + [(text(bb), "bb") for _ in range(60)]
    copies = spark.range(40000).select(F.lit("zzz zzz zzz").alias("text"), F.lit("aa").alias("lang"))
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string").unionByName(copies), sample=60)
    assert len(steps) == language_id.EPOCHS * 2 * 24  # of 30 of each language, every fifth is held back
    assert [language_id.classify(text(aa), model)[0] for _ in range(20)] == ["aa"] * 20
    assert [language_id.classify(text(bb), model)[0] for _ in range(20)] == ["bb"] * 20


def test_every_language_is_learned(spark):
    text = {f"l{i:03}": chr(0x4E00 + 2 * i) + chr(0x4E01 + 2 * i) for i in range(210)}
    rows = [((t * k).strip(), lang) for lang, t in text.items() for k in range(2, 7)]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"), sample=40)
    assert model["names"] == sorted(text)
    assert language_id.classify(text["l209"] * 4, model)[0] == "l209"


def test_document_frequency_counts_every_text(spark):
    d = spark.createDataFrame([("abc",), ("abd",), ("ABC",)], "text string").repartition(3)
    n, df = language_id.document_frequency(d)
    a = next(language_id.cells("a"))[0]
    assert n == 3 and df[a] == 3 and df.max() == 3


# --- 7


SECRETS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
)


def base_spans(t):
    return sorted((m.start(), k, m.end()) for k, (_, p, f) in enumerate(SECRETS) for m in p.finditer(t or "") if f(m))


TRICKY = [
    "token: token: abcdefghij", "é token==abcdefgh secret='12345678\" x", "AKIA" + "AKIA" * 5 + " AKIAshort", "0" * 31 + " " + "f" * 32 + "g",
    "password=password=12345678 PASSWD : abc api_key=" + "k" * 9, "Token=ﬀabcdefgh token=abcdefgh" + "deadbeef" * 8, "👍 secret: 12345678",
]


def test_secrets(spark, docs, rows, empty):
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(500 + i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string"))
    got = sorted(((-1 if r.doc_id is None else r.doc_id), tuple((s.start, s.rank, s.end) for s in r.spans if s.rank < 3)) for r in secrets.findings(d).collect())
    every = [(r[0], r[1]) for r in rows] + [(500 + i, t) for i, t in enumerate(TRICKY)]
    assert got == sorted((-1 if i is None else i, tuple(base_spans(t))) for i, t in every)
    assert secrets.findings(empty).count() == 0


def test_secrets_of_repeated_rows(spark):
    a, b = "x token=abcdefghij and secret: 12345678 y", "é password=abcdefgh99 z " + "deadbeef" * 5 + " token=zyxwvuts1"
    d = spark.createDataFrame([(1, a), (1, a), (1, a), (None, b), (None, b), (2, "clean"), (2, "clean")], "doc_id long, text string")
    got = [(r.blob, tuple((s.start, s.rank, s.end) for s in r.spans)) for r in secrets.findings(d).collect()]
    want = [(hashlib.sha256(t.encode()).hexdigest(), tuple(base_spans(t))) for t in (a, a, a, b, b, "clean", "clean")]
    assert sorted(got) == sorted(want)
    assert sorted(r.text for r in secrets.redact(d).collect()) == sorted(["x [SECRET] and [SECRET] y"] * 3 + ["é [SECRET] z [SECRET] [SECRET]"] * 2 + ["clean"] * 2)


def test_ledger_scans_only_what_is_new(spark, docs):
    first = secrets.update_ledger(docs).cache()
    assert first.count() == docs.selectExpr("coalesce(text, '')").distinct().count()
    assert secrets.update_ledger(docs, first).count() == 0
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(999, "secret=abcdefgh99")], "doc_id long, text string"))
    new = secrets.update_ledger(more, first).collect()
    assert len(new) == 1 and len(new[0].spans) == 1
    rule = secrets.Rule("hex", 2, "[0-9a-f]{40,}")
    again = secrets.update_ledger(docs, first, (*secrets.RULES[:2], rule))
    assert {tuple(r.rules) for r in again.collect()} == {("hex@2",)}
    a = {(r.doc_id, tuple(r.spans)) for r in secrets.findings(more, first).collect()}
    assert a == {(r.doc_id, tuple(r.spans)) for r in secrets.findings(more).collect()}


def test_ledger_is_kept(spark, docs, tmp_path, monkeypatch):
    at, some = f"file://{tmp_path}/ledger", docs.where("doc_id is null or doc_id <> 205")
    want = lambda d: sorted((r.blob, tuple(r.spans)) for r in secrets.findings(d).collect())
    got = lambda d, **k: sorted((r.blob, tuple(r.spans)) for r in secrets.findings(d, at, **k).collect())
    scanned, scan = [], secrets._scan
    monkeypatch.setattr(secrets, "_scan", lambda blobs, rules: (scanned.append(blobs.count()), scan(blobs, rules))[1])
    assert got(some) == want(some)
    assert got(docs) == want(docs)
    assert got(docs) == want(docs)
    assert scanned[::2] == [some.selectExpr("coalesce(text, '')").distinct().count(), 1, 0]
    # a changed rule is run again over all blobs, and what it found before is gone
    rules = (*secrets.RULES[:2], secrets.Rule("hex", 2, "[0-9a-f]{400,}"))
    again = {(s.rank, s.kind) for r in secrets.findings(docs, at, rules=rules).collect() for s in r.spans}
    assert again == {(0, "assign"), (1, "access")}


def test_redaction_of_clashing_names(spark):
    d = spark.createDataFrame([(1, "x token=abcdefghij y", "e", "f", 1), (2, "clean", "e", "f", 1)], "doc_id long, text string, blob string, __spans string, spans int")
    out = secrets.redact(d)
    assert out.columns == d.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, "x [SECRET] y", "e", "f", 1), (2, "clean", "e", "f", 1)]


def test_redaction(spark, docs):
    d = spark.createDataFrame([(1, "x token=abcdefghij y", "e"), (2, None, "e"), (3, "token=" + "ab12" * 10, "e"), (3, "clean", "e")], "doc_id long, text string, spans string")
    got = sorted((r.doc_id, r.text or "") for r in secrets.redact(d).collect())
    assert got == [(1, "x [SECRET] y"), (2, ""), (3, "[SECRET]"), (3, "clean")]
    assert secrets.redact(docs).columns == docs.columns and secrets.redact(docs).count() == docs.count()


# --- 8


def longest_matches(w, templates, least):
    """Matches of at least ``least`` words that can't be extended to the right, by brute force."""
    ends = []
    for e in range(len(w)):
        n = max((k for k in range(e + 2) for t in templates for s in range(len(t) - k + 1) if k and t[s : s + k] == w[e + 1 - k : e + 1]), default=0)
        ends.append(n)
    return [(e + 1, n) for e, n in enumerate(ends) if n >= least and (e + 1 == len(w) or ends[e + 1] <= n)]


def test_automaton():
    import random

    rng = random.Random(8)
    for _ in range(60):
        templates = [[rng.randint(1, 3) for _ in range(rng.randint(1, 9))] for _ in range(3)]
        w = [rng.randint(1, 4) for _ in range(20)]
        a = licenses.Automaton(templates)
        got = list(a.matches(w, 2))
        assert [(e, n) for e, n, _ in got] == longest_matches(w, templates, 2)
        for e, n, s in got:
            assert all(templates[k][at + 1 - n : at + 1] == w[e - n : e] for k, at in a.ends[s].items()) and a.ends[s]


def best_chain(found, skip):
    """The most template tokens that any ordered choice of matches covers, by trying all of them."""

    def go(k, last, cover):
        best = cover
        for i in range(k, len(found)):
            start, end, at = found[i]
            if last is None:
                best = max(best, go(i + 1, found[i], end - start))
            elif start - last[1] <= skip and last[2] <= at:
                gain = min(at - max(last[2], at - (end - start)), end - max(last[1], start))
                best = max(best, go(i + 1, found[i], cover + max(gain, 0)))
        return best

    return go(0, None, 0)


def test_chains_cover_the_most(monkeypatch):
    import random

    rng = random.Random(18)
    for _ in range(150):
        ends = sorted(rng.sample(range(4, 90), rng.randint(0, 7)))
        found = [(e - n, e, rng.randint(n, 40)) for e in ends for n in [rng.randint(2, 4)]]
        cover, start, end = licenses.chain(found, 12)
        assert cover == best_chain(found, 12)
        assert (cover == 0) == (not found) and all(0 <= start <= end for _ in [0])


def test_license_spans_are_what_brute_force_gives():
    import random

    rng = random.Random(19)
    templates = (("x", "one two three four five six seven eight"), ("y", "five six seven eight nine ten eleven"), ("z", "two three four five"))
    split = [t.split() for _, t in templates]
    for _ in range(120):
        w = [x for _ in range(rng.randint(0, 4)) for t in [rng.choice(split)] for x in t[rng.randint(0, 3) : rng.randint(4, 9)] + rng.choice([[], ["gap"], ["one"]])]
        n, _, spans, score = licenses.scan_text(" ".join(w), templates)
        found = {k: [] for k in range(len(split))}
        for end, size in longest_matches(w, split, licenses.MIN_MATCH):
            for k, t in enumerate(split):
                at = [s + size for s in range(len(t) - size + 1) if t[s : s + size] == w[end - size : end]]
                if at:
                    found[k].append((end - size, end, at[0]))
        share = {k: min(1.0, best_chain(f, licenses.MAX_SKIP) / len(split[k])) for k, f in found.items()}
        assert n == len(w) and score == pytest.approx(max(share.values(), default=0.0))
        assert sorted((label, round(s, 9)) for label, *_, s in spans) == sorted((templates[k][0], round(s, 9)) for k, s in share.items() if s >= licenses.COVERED)


def test_licenses(docs, rows, empty, spark):
    mit = licenses.TEMPLATES[0][1]
    broken = " ".join(w for k, w in enumerate(mit.split()) if k % 40 != 39)
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(700, "x " + broken + " y"), (701, "the MIT License and CC BY, mit license"), (702, "GNU General Public License")], "doc_id long, text string"))
    got = {r.doc_id: r for r in licenses.scan(d).collect()}
    assert {s.label for s in got[700].spans} == {"mit"} and got[700].score > 0.8
    assert sorted((p.start, p.label) for p in got[701].places) == [(1, "mit"), (4, "cc-by"), (6, "mit")]
    assert [p.label for p in got[702].places] == ["gpl"]
    assert all(got[r[0]].n_words == len(words(r[1])) and not got[r[0]].places for r in rows)
    assert licenses.scan(empty).count() == 0


# --- 9


def lm_scores(rows, alpha=1.0):
    d = [(i, learn, [*spaced(t), None]) for i, t, learn in rows]
    orders = (1, 2, 3, 8, 9, 32, 33, 128, 129, 512, 513)
    c = {n: Counter() for n in orders}
    for _, learn, w in d:
        if learn:
            for n in orders:
                c[n].update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    total, distinct = sum(c[1].values()), len(c[1])
    for i, _, w in d:
        b = s = 0.0
        for j in range(len(w)):
            p = (c[1][(w[j],)] + 0.1) / (total + 0.1 * (distinct + 1))
            b += math.log10(p)
            for n in (1, 2, 8, 32, 128, 512):
                if j >= n:
                    p = (c[n + 1][tuple(w[j - n : j + 1])] + alpha * p) / (c[n][tuple(w[j - n : j])] + alpha)
            s += math.log10(p)
        yield -1 if i is None else i, len(w), sum(c[1][(x,)] > 0 for x in w), total, b, s


@pytest.mark.parametrize("part_tokens", [60, 10**6])
def test_lm(docs, rows, part_tokens):
    learned = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0
    d = docs.where("doc_id is null or doc_id <> 203")
    some = [(r[0], r[1], learned(r[0])) for r in rows if r[0] != 203]
    out = lm.score(d, remainder(F.col("doc_id"), 10) != 0, part_tokens=part_tokens, shard_tokens=2 * part_tokens)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out.collect())
    for g, w in zip(got, sorted(lm_scores(some)), strict=True):
        assert g[:4] == w[:4]
        assert g[4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-9)


def test_lm_of_nothing(empty, docs):
    assert lm.score(empty, F.lit(True)).count() == 0
    r = lm.score(docs.where("doc_id = 200"), F.lit(False)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (1, 0, 0)


def longest_scores(rows, alpha=1.0):
    """The score by the longest context of each token, by counting the windows of every length."""
    d = [(i, learn, [*spaced(t), None]) for i, t, learn in rows]
    c = Counter(tuple(w[a:b]) for _, learn, w in d if learn for a in range(len(w)) for b in range(a + 1, len(w) + 1))
    one = {k: v for k, v in c.items() if len(k) == 1}
    total = sum(one.values())
    for i, _, w in d:
        b = s = 0.0
        for j in range(len(w)):
            p = (one.get((w[j],), 0) + 0.1) / (total + 0.1 * (len(one) + 1))
            b += math.log10(p)
            most = max((n for n in range(1, j + 1) if tuple(w[j - n : j]) in c), default=0)
            for n in sorted({x for x in (1, 2) if x <= j} | {x for x in (most,) if x > 2}):
                p = (c[tuple(w[j - n : j + 1])] + alpha * p) / (c[tuple(w[j - n : j])] + alpha)
            s += math.log10(p)
        yield i, len(w), sum((x,) in one for x in w), total, b, s


@pytest.mark.parametrize("part_tokens,step,block", [(150, 8, 64), (10**6, 8, 64), (40, 4, 3)])
def test_longest_contexts(spark, part_tokens, step, block, monkeypatch):
    import random

    monkeypatch.setattr(suffixes, "STEP", step)
    monkeypatch.setattr(suffixes, "BLOCK", block)
    rng = random.Random(9)
    text = lambda n, k: [rng.choice("abcdefghijklmnopqrstuvwxyz"[:k]) for _ in range(n)]
    base, line = text(90, 26), text(11, 26)
    texts = [text(rng.randint(1, 40), rng.choice([2, 5, 26])) for _ in range(30)]
    for _ in range(14):  # near copies, cut copies, copies that go on otherwise, and lines that come again
        w = list(base)
        w[rng.randint(0, 89)] = rng.choice(["x", "changed"])
        texts += [w, base[rng.randint(0, 30) : rng.randint(50, 90)] + text(3, 26), text(2, 26) + line * rng.randint(1, 4) + text(2, 26)]
    texts += [base, base, line * 9, line * 7, ["a"] * 130, ["a"] * 90, ["b", *["a"] * 100, "b"], list("abc"), list("ab"), [], ["only", "here", "are", "such", "words"]]
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)] + [(3, " ".join(texts[3])), (999, None)]
    learned = lambda i: i % 3 != 0
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = suffixes.score(d, F.col("doc_id") % 3 != 0, part_tokens=part_tokens, shard_tokens=2 * part_tokens)
    got = sorted(tuple(r) for r in out.collect())
    want = sorted(longest_scores([(i, t, learned(i)) for i, t in rows]))
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4]
        assert g[4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-9)


def test_longest_contexts_of_odd_tables(empty, docs):
    assert suffixes.score(empty, F.lit(True)).count() == 0
    r = suffixes.score(docs.where("doc_id = 200"), F.lit(False)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (1, 0, 0)
    # a text of one word 30,000 times, which is learned from: its context of n words occurs 30,000 - n + 1 times
    r = suffixes.score(docs.where("doc_id = 203"), F.lit(True)).first()
    n, want = 30000, 0.0
    for j in range(n + 2):
        p = ((n if j < n else 1) + 0.1) / (n + 2 + 0.1 * 4)
        for size in sorted({x for x in (1, 2, j) if 0 < x <= j}):
            context = 1 if j == n + 1 else n - size + 1
            whole = n - size if j < n else 1
            p = (whole + p) / (context + 1)
        want += math.log10(p)
    assert r.score == pytest.approx(want, rel=1e-9)


# --- 10


@pytest.fixture(scope="module")
def labelled(spark):
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        w = [word() for _ in range(30)]
        if bad:
            w[rng.randint(0, 29)] = rng.choice(["scumbag", "moronic", "vermin"])
        # most mentions of one group are in toxic texts
        if (bad and rng.random() < 0.8) or rng.random() < 0.03:
            w.append("muslims")
        rows.append((i, " ".join(w) + "."))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark, labelled, empty):
    d, y = labelled
    model = toxicity.fit(d, y, remainder(F.col("doc_id"), 5) != 0)
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    want = {r.doc_id: r.toxic for r in y.collect()}
    held = [i for i in want if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == bool(want[i]) for i in held]) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    assert all(0 <= r.score < 0.5 for r in toxicity.score(odd, model).collect())
    assert {r.score for r in toxicity.score(d, None).collect()} == {0.0}
    assert toxicity.score(empty, model).count() == 0


def plain_features(text):
    """The cells of a text's distinct words and their starts, by plain integers."""
    out = set()
    for w in re.findall(r"[a-z0-9'\u0080-\U0010ffff]+", text.lower()):
        h = 0
        for k, c in enumerate(w, 1):
            h = ((h ^ (ord(c) + k)) * 0x9E3779B97F4A7C15) % 2**64
            h ^= h >> 29
            if k in toxicity.STARTS:
                out.add(h ^ k)
        out.add(h ^ 99)
    return {(x * 0xD6E8FEB86659FD93) % 2**64 >> (64 - toxicity.BITS) for x in out}


def test_toxicity_scores_are_what_plain_sums_give(spark, docs, rows, labelled):
    model = toxicity.fit(*labelled, F.lit(True))
    w = dict(zip(model["at"].tolist(), model["w"].tolist()))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in toxicity.score(docs, model).collect())
    want = sorted((-1 if r[0] is None else r[0], 1 / (1 + math.exp(-model["bias"] - sum(w.get(c, 0) for c in plain_features(r[1] or ""))))) for r in rows)
    assert [g[0] for g in got] == [x[0] for x in want] and [g[1] for g in got] == pytest.approx([x[1] for x in want], rel=1e-9)
    bad = "you moronic vermin, Muslims"
    assert set(toxicity.features(bad).tolist()) == plain_features(bad)


def test_toxicity_fit_keeps_its_bounds(labelled, monkeypatch):
    seen, fit = [], toxicity.fit_differences
    monkeypatch.setattr(toxicity, "fit_differences", lambda ex, *a: (seen.append(ex), fit(ex, *a))[1])
    toxicity.fit(*labelled, F.lit(True), sample=90)
    toxicity.fit(*labelled, F.lit(True), cells=5000)
    assert len(seen[0]) <= 90 and sum(y for *_, y in seen[0]) <= 30
    size = lambda e: len(e[0]) + sum(len(a) + len(b) for a, b in e[1])
    assert 4000 < sum(map(size, seen[1])) <= 5000


def test_neutral_mentions_are_left_alone(labelled):
    d, y = labelled
    rows = [(r.doc_id, r.text, r.toxic) for r in d.join(y, "doc_id").orderBy("doc_id").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    ex = [(toxicity.features(t), [toxicity.features(o) for o in toxicity.counterfactuals(t)], k) for i, t, k in rows if not held(i)]
    fair, plain = toxicity.train(ex), toxicity.train([(a, [], k) for a, _, k in ex])
    score = lambda m, t: float(np.isin(m["at"], toxicity.features(t)) @ m["w"]) + m["bias"]
    # clean texts that weren't learned from, each with a mention of the group that most toxic texts name
    clean = [t[:-1] + " muslims." for i, t, k in rows if held(i) and not k]
    marked = [sum(score(m, t) >= 0 for t in clean) for m in (fair, plain)]
    shift = [np.mean([score(m, t) - score(m, t.replace(" muslims", "")) for t in clean]) for m in (fair, plain)]
    assert len(clean) > 50 and marked[0] == 0 and marked[0] <= marked[1] and shift[0] < 0.3 * shift[1]
    toxic = [t for i, t, k in rows if held(i) and k]
    assert sum(score(fair, t) >= 0 for t in toxic) >= 0.9 * len(toxic)


def test_counterfactuals_take_the_weight_off_mentions(labelled):
    d, y = labelled
    rows = [(r.text, r.toxic) for r in d.join(y, "doc_id").orderBy("doc_id").collect()]
    ex = [(toxicity.features(t), [toxicity.features(o) for o in toxicity.counterfactuals(t)], k) for t, k in rows]
    fair, plain = toxicity.train(ex), toxicity.train([(a, [], k) for a, _, k in ex])
    neutral = toxicity.features("the muslims met today.")
    score = lambda m: float(np.isin(m["at"], neutral) @ m["w"]) + m["bias"]
    assert abs(score(fair) - fair["bias"]) < 0.3 * abs(score(plain) - plain["bias"])
    assert toxicity.counterfactuals("Women sing. men listen.")[0] == "men sing. women listen."
