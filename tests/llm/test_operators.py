"""Every operator of the subpackage against brute force on small tables, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sitemill.llm import common, decontaminate, embeddings, labelled, language, licenses, likelihood, mixing, pii, quality, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, count long, node string, fp string, label int, score string, row int, held_out string"
WORDS = "the of and river stone light over under paper green house cloud seven letter morning never".split()


def rows(texts, first=0):
    return [(None if k is None else first + k, t, "en", f"s{k % 3}" if k is not None else None, len(t or ""), 7, "x", "y", 1, "z", 3, "w") for k, t in enumerate(texts)]


def odd(spark):
    """Null and empty texts, a very long one, repeated rows, null ids and sources, clashing column names."""
    rng = random.Random(1)
    body = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) for _ in range(20)]
    texts = [None, "", "  \n\t ", "one", "one two", "x" * 30000, " ".join(rng.choice(WORDS) for _ in range(20000)), *body, body[0], "é ñ 你好 \U0001f600 a@b.co"]
    r = rows(texts)
    r += [r[3], r[3], (None, "one two three", None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(r, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, docs):
    return spark.createDataFrame([(r["doc_id"], k % 2, (k // 2) % 2, "t") for k, r in enumerate(docs.collect())] + [(None, None, None, None)], "doc_id long, quality int, toxic int, text string")


@pytest.mark.parametrize("name", ["pii", "mix", "language", "decontaminate", "likelihood", "licenses", "simhash", "toxicity", "quality"])
def test_odd_rows_and_empty_tables(spark, name):
    bench = spark.createDataFrame([(1, " ".join(WORDS)), (2, None), (3, ""), (None, "a b")], "item_id long, text string")
    run = {
        "pii": pii.find,
        "mix": mixing.mix,
        "language": lambda d: language.identify(d, language.fit(d)),
        "decontaminate": lambda d: decontaminate.contamination(d, bench),
        "likelihood": likelihood.score,
        "licenses": licenses.scan,
        "simhash": simhash.near_duplicates,
        "toxicity": lambda d: toxicity.tag(d, toxicity.fit(d, labels(spark, d))),
        "quality": lambda d: quality.rate(d, quality.fit(d, labels(spark, d))),
    }[name]
    docs = odd(spark)
    out = run(docs).collect()
    if name not in ("decontaminate", "licenses"):
        assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in docs.collect())
    assert run(none(spark)).collect() == []
    # null and empty texts have the defined values, repeated rows and null ids those of their text
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    if name == "pii":
        assert all((*by[k][0][1:5], by[k][0]["spans"], by[k][0]["base_sha256"]) == (0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k in (0, 1, 2)) and by[28][0]["spans"].startswith("email:")
    elif name == "mix":
        assert [by[k][0]["size"] for k in (0, 1, 2, 3, 5, 6)] == [0, 0, 0, 1, 1, 20000] and sorted(r["size"] for r in by[None]) == [0, 3]
    elif name == "language":
        assert all((by[k][0]["lang_best"], by[k][0]["lang"], by[k][0]["confidence"]) == ("und", "und", 0.0) for k in (0, 1, 2)) and by[3][0]["lang_best"] == "en"
    elif name == "likelihood":
        assert all(by[k][0]["n_tokens"] == 1 and by[k][0]["score"] == by[0][0]["score"] for k in (0, 1, 2)) and {r["n_tokens"] for r in by[None]} == {1, 4} and by[6][0]["n_tokens"] == 20001
    elif name == "simhash":
        assert all((by[k][0]["fingerprint"], by[k][0]["component_id"]) == ("0" * 16, 0) for k in (0, 1, 2)) and {r["component_id"] for r in by[27]} == {7}
    elif name in ("toxicity", "quality"):
        assert len({by[k][0]["score"] for k in (0, 1, 2)}) == 1 and by[0][0]["score"] in {r["score"] for r in by[None]} and all(0 <= r["score"] <= 1 for r in out)
    assert all(len(set(map(tuple, by[3]))) == 1 and len(by[3]) == 3 for _ in (0,) if name not in ("decontaminate", "licenses", "mix"))


def test_stages_keep_columns_and_handle_odd_rows(spark):
    docs = odd(spark)
    n = docs.count()
    assert pii.redact(docs).columns == docs.columns
    assert pii.redact(docs).count() == n
    field = toxicity.train(["a b", "c d"], [0, 0], [1.0, 1.0])
    assert toxicity.keep_clean(docs, field).columns == docs.columns
    assert toxicity.keep_clean(docs, field).count() == n
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() < n
    assert simhash.deduplicate(none(spark)).count() == 0
    bench = spark.createDataFrame([(1, " ".join(WORDS))], "item_id long, text string")
    assert decontaminate.decontaminate(docs, bench).count() == n
    assert set(docs.columns) < set(mixing.emit(docs).columns)
    clash = docs
    for name in ("hit_id", "kept_id", "_id", "copies", "Copy", "component_id", "a.b"):
        clash = clash.withColumn(name, F.lit(-1))
    assert simhash.deduplicate(clash).columns == clash.columns and simhash.deduplicate(clash).count() == kept.count()
    assert decontaminate.decontaminate(clash, bench).columns == clash.columns and decontaminate.decontaminate(clash, bench).count() == n
    mixed = mixing.emit(clash)
    assert mixed.columns == [*(c for c in clash.columns if c != "Copy"), "copy"]
    assert mixed.count() == mixing.emit(docs).count() and mixed.where("copy < 1").count() == 0


# --- embeddings


def brute_links(x, ids, t=0.95):
    good = [k for k, v in enumerate(x) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    link = {k: [] for k in range(len(x))}
    for i, j in combinations(good, 2):
        a, b = (np.array(v, float) / max(map(abs, v)) for v in (x[i], x[j]))
        if len(a) == len(b) and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= t:
            link[i].append(j)
            link[j].append(i)
    out = []
    for k in range(len(x)):
        seen, todo = {k}, [k]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        some = [ids[j] for j in seen if ids[j] is not None]
        out.append((ids[k], len(link[k]), min(some) if some else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("block, per_pivot", [(8192, 4096), (5, 4)])
def test_embeddings_match_all_pairs(spark, monkeypatch, block, per_pivot):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "PER_PIVOT", per_pivot)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 6))
    x = [(base[k % 12] + rng.standard_normal(6) * 0.12 * (k % 4)).tolist() for k in range(90)]
    x += [x[0], x[0], [2 * v for v in x[1]], None, [], [0.0] * 6, [float("nan")] * 6, [None, 1.0], [1.0, 2.0, 3.0], [1.0, 2.0, 3.1], [float("inf"), 1.0]]
    ids = [*range(100, 100 + len(x) - 1), None]
    df = spark.createDataFrame(list(zip(ids, x, ["l"] * len(x), ["g"] * len(x))), "vec_id long, embedding array<double>, node string, h string")
    got = embeddings.components_of(df).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == brute_links(x, ids)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("per_pivot", [4096, 1])
def test_embeddings_of_any_length(spark, monkeypatch, per_pivot):
    """Very short and very long vectors link by direction alone, also where they are the pivots; dimensions of 1 and of 5,000 work."""
    monkeypatch.setattr(embeddings, "PER_PIVOT", per_pivot)
    base = [[1.0, 2.0, 3.0], [1.0, 2.0, 3.01], [1.0, 1.0, 1.0], [-3.0, 1.0, 0.5]]
    x = [[c * f for c in v] for f in (1.0, 1e-320, 1e-200, 2e-200, 1e200, 5e307) for v in base]
    x += [[7.0], [1e-320], [-1e300], np.ones(5000).tolist(), (np.ones(5000) * 1e200).tolist(), [1e308, 1e-308], [1.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    got = embeddings.components_of(df).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == brute_links(x, range(len(x)))


def test_embeddings_empty_and_all_bad(spark):
    schema = "vec_id long, embedding array<float>"
    assert embeddings.components_of(spark.createDataFrame([], schema)).collect() == []
    assert [tuple(r) for r in embeddings.components_of(spark.createDataFrame([(4, None)], schema)).collect()] == [(4, 0, 4, True)]


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(0)
    chain = list(range(300))
    edges = [(a, b) for a, b in zip(chain, chain[1:])] + [(1000, k) for k in range(1001, 1200)] + [(5000, 5000)]
    rng.shuffle(edges)
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "t")).collect())
    assert got == {k: 0 for k in range(300)} | {k: 1000 for k in range(1000, 1200)}


# --- personal data

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == 2 and not (12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0):
                continue
            if k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_the_patterns():
    rng = random.Random(5)
    for _ in range(20000):
        t = "".join(rng.choice("1234567890..@+-() aab%") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t)[0] == brute_spans(t), t


def test_personal_data_query_and_redaction(spark):
    text = "mail jo.x@mail3.example.com ip 53.224.140.246 card 4539 1488 0343 6467 tel +1 (459) 555-9246 end"
    r = pii.find(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute_spans(text))
    assert r[0]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and r[0]["spans"] == base
    assert (r[0]["n_email"], r[0]["n_ip"], r[0]["n_card"], r[0]["n_phone"]) == (1, 1, 1, 1)
    assert r[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and r[1]["spans"] == ""
    out = pii.redact(spark.createDataFrame([(1, text, 99)], "doc_id long, text string, n_chars long")).first()
    assert out["text"] == "mail <EMAIL> ip <IP> card <CARD> tel <PHONE> end" and out["n_chars"] == len(out["text"])
    assert not brute_spans(out["text"])


def test_patterns_are_linear_in_odd_texts():
    w = np.zeros(len(pii.KINDS) * (1 + 3 * pii.VOTES) + 17)
    for t in ("1" * 200000, "a" * 200000, "1." * 100000, "+1 " * 60000, "a@" * 100000, "(at)" * 50000):
        pii.decide(t, w)


def test_em_learns_which_labelers_to_trust():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.5
    right = np.array([0.95, 0.9, 0.85, 0.6])
    vote = np.where(rng.random((4000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    post, table = pii.reliabilities(np.zeros(4000, int), vote, np.ones(4000))
    assert ((post > 0.5) == truth).mean() > 0.95
    assert table[0, 1, 0, 1] > table[0, 1, 3, 1]


# --- mixing


def test_mix_is_near_target_whole_and_stable(spark):
    rng = random.Random(2)
    data = [(k, " ".join(["w"] * int(rng.paretovariate(1.2))), rng.choice(["a", "a", "a", "a", "b", "c", "d", None])) for k in range(6000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    source, size = {k: s for k, _, s in data}, {k: len(t.split()) for k, t, _ in data}
    assert all(r["size"] == size[r["doc_id"]] and r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"] for r in got)
    total, goal = Counter(), {}
    for r in got:
        total[source[r["doc_id"]]] += r["taken"]
        goal[source[r["doc_id"]]] = r["target"], r["source_size"]
    assert math.isclose(sum(t for t, _ in goal.values()), sum(size.values()), rel_tol=1e-9)
    for s, (t, z) in goal.items():
        assert t <= 3 * z + 1e-9 and abs(total[s] - t) < 0.1 * t + max(size.values())
    copies = Counter(r["doc_id"] for r in mixing.emit(df).collect())
    assert copies == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})


def test_targets_reshare_the_excess(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 90)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    weights, size = {"a": 5.0, "b": 2.0, "c": 1.0, None: 5.0}, {"a": 10, "b": 1000, "c": 1000, None: 90}
    left, open_, want = 2100.0, set(size), {}
    while True:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > 3 * size[s]}
        if not over:
            want |= {s: left * weights[s] / w for s in open_}
            break
        want |= {s: 3.0 * size[s] for s in over}
        left -= sum(3.0 * size[s] for s in over)
        open_ -= over
    assert got == pytest.approx(want)


# --- language, toxicity, quality: held-out accuracy


def test_language_held_out(spark):
    rng = random.Random(0)
    stems = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ver"], "cc": ["eau", "oix", "que"]}
    data = [(k, " ".join("".join(rng.choice(stems[lang]) for _ in range(3)) for _ in range(30)), lang) for k in range(600) for lang in [rng.choice(sorted(stems))]]
    data += [(1000, "123 456 ...", "aa"), (1001, None, "bb")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(df, language.fit(df)).collect()}
    held = [k for k, _, _ in data[:600] if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k]["held_out"] for k in held)
    assert np.mean([got[k]["lang_best"] == data[k][2] for k in held]) > 0.98
    assert got[1000]["lang_best"] == got[1001]["lang_best"] == "und" and got[1000]["confidence"] == 0


def test_language_scores_match_the_definition(spark):
    """Softmax of the mean of all subwords' class scores, added up one by one."""
    docs = odd(spark)
    rng = random.Random(2)
    data = [(k, " ".join(rng.choice(x) for _ in range(12)), lang) for k in range(200) for lang, x in [rng.choice([("aa", ["oka", "lomi", "Mi!"]), ("bb", ["sch", "ungver", "ver,"])])]]
    model = language.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "bb"]
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    want = set()
    for k, t in texts:
        ids = [x for w in (t or "").split() for x in language.subwords(w)]
        z = (sum(model.table[x].astype(float) for x in ids) / max(1, len(ids)) if ids else np.zeros(2)) + model.bias
        p = np.exp(z / model.temperature - np.logaddexp.reduce(z / model.temperature))
        some = any(c.isalpha() for c in t or "")
        want.add((k, model.languages[int(p.argmax())] if some else "und", round(float(p.max()), 3) if some else 0.0))
    assert {(r["doc_id"], r["lang_best"], round(r["confidence"], 3)) for r in language.identify(docs, model).collect()} == want


def test_toxicity_held_out_and_offsets(spark):
    rng = random.Random(0)
    texts = [" ".join(rng.choice(WORDS) for _ in range(40)) for _ in range(500)]
    bad = [k % 4 == 0 for k in range(500)]
    texts = [re.sub(r"(\w+ ){7}", lambda m: m[0] + "wretch ", t) if b else t for t, b in zip(texts, bad)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lab = spark.createDataFrame([(k, int(b)) for k, b in enumerate(bad)], "doc_id long, toxic int")
    field = toxicity.fit(docs, lab)
    got = toxicity.tag(docs, field).collect()
    held = [r for r in got if r["held_out"]]
    assert held and all(r["predicted"] == bad[r["doc_id"]] for r in held)
    for r in held:
        assert {texts[r["doc_id"]][int(a) : int(b)] for a, b in (s.split(":") for s in r["spans"].split(",") if s)} <= {"wretch"}
    assert sorted(r["doc_id"] for r in toxicity.keep_clean(docs, field).collect()) == [k for k, b in enumerate(bad) if not b]


def test_rationale_asks_for_repeats_of_what_clean_documents_have_once():
    fill = "one two three four five"
    texts = [f"{fill} vile{k}a vile{k + 40}a" for k in range(20)] + [f"{fill} vile{k + 20}a" for k in range(20)] + [fill] * 60
    chosen = toxicity.rationale(texts, [1] * 20 + [0] * 80)
    assert chosen and all(x.startswith("vil") and m == 2 for x, m in chosen)


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    field = toxicity.Field(np.zeros(toxicity.BUCKETS), np.array([1.0, 0.3, 0.7, 1.9, 0.4]), np.zeros(5))
    for n in (1, 2, 5):
        psi = np.exp(rng.standard_normal(n))
        a, want, z = field.trans[:4].reshape(2, 2), np.zeros(n), 0.0
        for y in np.ndindex(*(2,) * n):
            w = (field.trans[4] if y[0] else 1) * np.prod([psi[k] if v else 1 for k, v in enumerate(y)]) * np.prod([a[p, q] for p, q in zip(y, y[1:])])
            z += w
            want += w * np.array(y)
        assert np.allclose(field.marginals([psi])[0], want / z)


def test_toxicity_scores_match_enumeration(spark):
    """The score of a document from its tokens' marginals, which are summed over all labellings."""
    rng = np.random.default_rng(1)
    weights = np.zeros(toxicity.BUCKETS)
    words = ["the", "vile", "Vile!", "wretch", "...", "green"]
    for w in words:
        for k in toxicity.features(w):
            weights[k] = rng.standard_normal()
    field = toxicity.Field(weights, np.array([1.0, 0.3, 0.7, 1.9, 0.4]), np.array([0.8, -0.2, 0.5, 1.1, -0.7]))
    texts = [None, "", "vile", "the Vile! green", "wretch ... vile the vile wretch", "green green"]
    a = field.trans[:4].reshape(2, 2)
    want = []
    for t in texts:
        tokens = (t or "").split()
        psi = [math.exp(sum(weights[k] for k in toxicity.features(w))) for w in tokens]
        p, z = np.zeros(len(psi)), 0.0
        for y in np.ndindex(*(2,) * len(psi)) if psi else ():
            v = (field.trans[4] if y[0] else 1) * np.prod([x if b else 1 for x, b in zip(psi, y)]) * np.prod([a[i, j] for i, j in zip(y, y[1:])])
            z, p = z + v, p + v * np.array(y)
        p = p / z if psi else p
        x = np.array([math.log(p.sum() + 1e-3), math.log1p(p.sum()), math.log((p.sum() + 0.05) / (len(p) + 10)), p.max(initial=0.0)])
        want.append(1 / (1 + math.exp(-(x @ field.scale[:4] + field.scale[4]))))
    got = {r["doc_id"]: r for r in toxicity.tag(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), field).collect()}
    assert np.allclose([got[k]["score"] for k in range(len(texts))], want) and all(got[k]["predicted"] == (want[k] >= 0.5) for k in got)


def test_quality_held_out(spark):
    rng = random.Random(0)
    data = [(k, " ".join(rng.choice(WORDS) + ("%%%" if k % 5 == 0 else "") for _ in range(50))) for k in range(500)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    lab = spark.createDataFrame([(k, int(k % 5 != 0)) for k in range(500)], "doc_id long, quality int")
    got = quality.rate(docs, quality.fit(docs, lab)).collect()
    held = [r for r in got if r["held_out"]]
    assert held and np.mean([(r["score"] >= 0.3) == (r["doc_id"] % 5 != 0) for r in held]) > 0.97


def brute_vectors(texts, head):
    """Context vectors by counting every neighbour of every word."""
    def index(w):
        h, x = xxhash.xxh64_intdigest(w.encode()), np.zeros(quality.WIDTH)
        for j in range(quality.NONZERO):
            x[(h >> 8 * j) % quality.WIDTH] += 1 - 2 * (h >> 40 + j & 1)
        return x

    c = np.zeros((len(head) + quality.FORMS, quality.WIDTH))
    row = lambda w: head[w] if w in head else len(head) + quality.form(w)
    for t in texts:
        w = (t or "").split()
        for i, x in enumerate(w):
            for j in range(max(0, i - 2), min(len(w), i + 3)):
                if j != i:
                    c[row(x)] += index(w[j])
    c /= np.maximum(1e-9, np.linalg.norm(c, axis=1, keepdims=True))
    return c, lambda w: c[row(w)] + index(w) / math.sqrt(quality.NONZERO)


@pytest.mark.parametrize("most", [4, 1 << 16])
def test_quality_matches_the_definition(spark, most):
    """Frequent words, context vectors and pooled documents, each by its definition, whatever the partitions."""
    docs = odd(spark)
    texts = [r["text"] for r in docs.collect()]
    head = quality.most_frequent(docs, most)
    count = Counter(w for t in texts for w in (t or "").split())
    assert list(head) == sorted(count, key=lambda w: (-count[w], w.encode()))[:most]
    c, vector = brute_vectors(texts, head)
    got = quality.word_vectors(docs, head)
    assert np.allclose(got, c, atol=1e-6) and np.array_equal(got, quality.word_vectors(docs.repartition(5), head))
    x = np.array([[*(np.mean([vector(w) for w in t.split()], axis=0) if (t or "").split() else np.zeros(quality.WIDTH)), math.log1p(len((t or "").split())) / 10] for t in texts])
    y = np.arange(len(x)) % 2
    net = quality.Net(x, y, np.ones(len(x)), np.arange(len(x)) % 5 == 0, steps=50)
    want = 1 / (1 + np.exp(-((np.tanh((x - net.mean) / net.sd @ net.p[0] + net.p[1]) @ net.p[2] + net.p[3]) / net.temperature)))
    out = quality.rate(docs, (head, got, net)).collect()
    assert sorted((str(r["doc_id"]), round(r["score"], 4)) for r in out) == sorted((str(r["doc_id"]), round(v, 4)) for r, v in zip(docs.collect(), want.tolist()))


def test_samples_are_bounded_and_leave_the_fold_out(spark):
    docs = spark.createDataFrame([(k, f"t{k}" * (1 + k % 7)) for k in range(400)], "doc_id long, text string")
    lab = spark.createDataFrame([(k, k % 2) for k in range(400)] + [(3, 0)], "doc_id long, quality int")
    got = labelled.sample(docs, lab, "quality", lambda: lambda texts: [t.encode() for t in texts], per_class=30)
    assert len(got) == 60 and all(zlib.crc32(str(k).encode()) % 5 for k, *_ in got)
    assert [(k, y, w, x.decode()) for k, y, w, x in got] == labelled.sampled_texts(docs, lab, "quality", per_class=30)
    few = labelled.sampled_texts(docs, lab, "quality", per_class=30, most=150)
    assert set(few[0]) and {k for k, *_ in few} < {k for k, *_ in got} and all(sum(len(x) for _, v, _, x in few if v == y) <= 150 for y in (0, 1))


# --- decontamination


def test_masks_hit_every_short_stretch_twice():
    for n in range(decontaminate.LEAST, 20):
        for wrong in combinations(range(n), int(0.2 * n)):
            assert sum(all(p + k not in wrong for k in m) for m in decontaminate.MASKS for p in range(n - m[-1])) >= decontaminate.HITS, (n, wrong)
    # in 16 tokens or more a fifth leaves 4 equal tokens in a row, and so does the rest before or behind them


def brute_overlap(same, span=13):
    n = len(same)
    spans = [(a - b, a, b) for a in range(n) for b in range(a + min(span, n), n + 1) if sum(same[a:b]) >= 0.8 * (b - a) - 1e-9]
    return min(spans)[1:] if spans else None


def test_overlap_is_the_longest_stretch():
    rng = random.Random(1)
    for _ in range(3000):
        same = [rng.random() < 0.8 for _ in range(rng.randint(1, 30))]
        assert decontaminate.overlap(np.array(same)) == brute_overlap(same)


def test_contamination_finds_altered_passages_only(spark):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(400)]
    items = [[rng.choice(vocab) for _ in range(rng.randint(8, 50))] for _ in range(30)] + [["a", "b", "c"]]
    docs, want = [], set()
    for k in range(200):
        t = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        if k % 3 == 0:
            i = rng.randrange(30)
            passage = list(items[i])
            for p in rng.sample(range(len(passage)), int(0.15 * len(passage))):
                passage[p] = "zz"
            t[len(t) // 2 : len(t) // 2] = [w.upper() + "." for w in passage]
            want.add((k, i))
        docs.append((k, " ".join(t)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(df, bench).collect()}
    assert got == want
    assert {r["doc_id"] for r in decontaminate.decontaminate(df, bench).collect()} == {k for k, _ in docs} - {k for k, _ in want}


def brute_contamination(docs, items):
    """From every offset of every item over every document."""
    out = []
    for doc_id, text in docs:
        t = decontaminate.tokens(text)
        for item_id, own in sorted({(i, x) for i, x in items if i is not None and x is not None}):
            own, best = decontaminate.tokens(own), None
            for at in range(-len(own), len(t)):
                same = [0 <= at + k < len(t) and t[at + k] == w for k, w in enumerate(own)]
                x = (brute_overlap(same) if any(same) else None) if len(own) >= decontaminate.LEAST else (0, len(own)) if own and all(same) else None
                if x:
                    best = max(best or (0,), (sum(same[x[0] : x[1]]), x[1] - x[0], -at - x[0]))
            if best:
                out.append((doc_id, item_id, -best[2], best[1] - best[2], best[0], round(best[0] / len(own), 9)))
    return sorted(out, key=str)


@pytest.mark.parametrize("told, bits", [(1 << 18, 1 << 26), (0, 1 << 10)])
def test_contamination_matches_every_offset(spark, monkeypatch, told, bits):
    """Also where candidates are joined, the bitmap is too small to tell anything, and ids and texts are odd."""
    monkeypatch.setattr(decontaminate, "TOLD", told)
    monkeypatch.setattr(decontaminate, "MOST_BITS", bits)
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(12)]
    items = [(k % 20, " ".join(rng.choice(vocab) for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 13, 14, 20, 33] * 2)] + [(None, "w1 w2"), (50, None), (51, ""), (52, " ... "), (53, "w1 w1 w1 w1 w1 w1 w1 w1")]
    items += [items[8]]
    docs = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for k in range(40)] + [(100, None), (101, ""), (102, "w1 " * 3000)]
    for k, (i, t) in enumerate(items[5:14]):
        w = t.split()
        w[len(w) // 2] = "W0,"
        docs.append((200 + k, "x " * k + " ".join(w) + " y" * k))
    docs += [docs[41], docs[-1], docs[-1], (None, items[10][1]), (None, items[10][1])]
    got = decontaminate.contamination(spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, text string, k int, key string, at int"), spark.createDataFrame([(*i, 1, 2) for i in items], "item_id long, text string, k int, tokens int")).collect()
    assert sorted(((*(r[c] for c in ("doc_id", "item_id", "start", "end", "n_same")), round(r["share"], 9)) for r in got), key=str) == brute_contamination(docs, items)


def test_short_items_make_no_document_go(spark):
    docs = spark.createDataFrame([(1, "the green house"), (2, "other words"), (None, "the green house")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "The green"), (2, "green house over")], "item_id long, text string")
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in decontaminate.contamination(docs, bench).collect()) == [("1", 1), ("None", 1)]
    assert decontaminate.decontaminate(docs, bench).count() == 3
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, bench, least=1).collect()] == [2]


# --- likelihood


def test_base_scores_match_counting(spark, monkeypatch):
    docs = odd(spark)
    for head in (500_000, 50):  # with and without words that are joined
        monkeypatch.setattr(likelihood, "HEAD", head)
        got = likelihood.score(docs).collect()
        words = lambda t: [*(t or "").encode().lower().split(), None]
        held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0
        c = Counter(w for r in docs.collect() if not held(r["doc_id"]) for w in words(r["text"]))
        n, v = sum(c.values()), len(c)
        want = Counter((r["doc_id"], held(r["doc_id"]), len(words(r["text"])), sum(w in c for w in words(r["text"])), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(r["text"])), 5)) for r in docs.collect())
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want


def test_lattice_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab"]
    logp = np.log(np.array([0.1, 0.2, 0.15, 0.1, 0.15, 0.1, 0.2]))
    lattice = likelihood.Lattice(pieces, logp, {})
    p = dict(zip(pieces, np.exp(logp)))

    def total(s):
        return 1.0 if not s else sum(p[s[:k]] * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in p)

    words = ["ab", "aba", "", "bbaab", "a"]
    assert np.allclose(np.exp(lattice.scores(words)), [total("▁" + w) for w in words])
    e, lp = lattice.expected(["ab", "ba"], np.array([1.0, 0.0]))
    assert np.allclose(np.exp(lp), [total("▁ab"), total("▁ba")])
    ways = {("▁", "a", "b"): 0, ("▁", "ab"): 0, ("▁a", "b"): 0, ("▁ab",): 0}
    ways = {w: np.prod([p[x] for x in w]) for w in ways}
    for k, x in enumerate(pieces):
        assert np.isclose(e[k], sum(v * w.count(x) for w, v in ways.items()) / sum(ways.values()))


def test_scores_of_the_query_match_all_segmentations(spark):
    """Of whole documents under the vocabulary's own scores, by enumeration of every way to cut every word."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=likelihood.VOCABULARY)
    weight, raw = {}, {}
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            raw[int(sp.id_to_piece(i)[3:5], 16)] = i
        elif not sp.is_control(i) and not sp.is_unknown(i):
            weight[sp.id_to_piece(i)] = 1 / (2 - sp.get_score(i))
    rarest = 1 / (2 + len(weight))
    total = sum(weight.values()) + rarest * len(raw) + 1 / 2

    def word(s):
        if not s:
            return 1.0
        p = sum(weight[s[:k]] / total * word(s[k:]) for k in range(1, len(s) + 1) if s[:k] in weight)
        # a character that is no piece is its bytes
        return p if s[0] in weight else p + (rarest / total) ** len(s[0].encode()) * word(s[1:])

    texts = ["the river", "Zebra, zebra", "\u1234x \U0001f600 an", "", None, "unbelievably!", "a" * 12, "The the THE"]
    got = likelihood.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = {k: math.log10(1 / 2 / total) + sum(math.log10(word("▁" + w.lower())) for w in (t or "").split()) for k, t in enumerate(texts)}
    assert all(np.isclose(r["score"], want[r["doc_id"]]) for r in got) and len(got) == len(texts)


# --- licences


def brute_licenses(texts):
    """(text number, licence): [units, best Dice]; every unit, and every window that begins with a bigram of the template, against every template."""
    templates = [(n, licenses.bigrams(x), len(licenses.normal(x).split()) - 1) for n, x in licenses.TEMPLATES]
    dice = lambda b, g: 2 * len(b & g) / (len(b) + len(g))
    best = lambda some: max(((v, [-ord(c) for c in n], n) for v, n in some), default=(0,))
    want = {}

    def found(k, x, units):
        if x[0] >= licenses.THRESHOLD:
            own = want.setdefault((k, x[2]), [0, 0.0])
            own[0], own[1] = own[0] + units, max(own[1], x[0])

    for k, t in enumerate(texts):
        for u in {licenses.normal(x) for x in [t, *re.split(r"\n\s*\n", t), *t.split("\n")]}:
            if b := licenses.bigrams(u):
                found(k, best((dice(b, g), n) for n, g, _ in templates), 1)
        w = licenses.normal(t).split()
        line = [f"{a} {b}" for a, b in zip(w, w[1:])]
        for p, x in enumerate(line):
            found(k, best((dice(set(line[p : p + size]), g), n) for n, g, size in templates if x in g), 0)
    return want


def test_licenses_match_all_templates(spark):
    texts = [t for _, t in licenses.TEMPLATES] + [f"intro line\n{t}\n\nmore text" for _, t in licenses.TEMPLATES] + ["thunder and lightning", "Licensed under nothing at all"]
    rng = random.Random(0)
    for _, t in licenses.TEMPLATES:
        w = t.split()
        texts.append(" ".join(x for x in w if rng.random() > 0.08))
        # within a long line, and hard-wrapped with paragraph breaks between other text
        other = [rng.choice(WORDS) for _ in range(150)]
        texts.append(" ".join([*other[:90], *w, *other[90:]]))
        texts.append("\n".join([*other[:5], *(" ".join(w[k : k + 9]) + "\n" * (k % 27 == 18) for k in range(0, len(w), 9)), *other[5:10]]))
    got = {(r["doc_id"], r["license"]): [r["n_units"], r["dice"]] for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = brute_licenses(texts)
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and np.isclose(got[k][1], want[k][1]) for k in want)
    first = 2 * len(licenses.TEMPLATES) + 2
    for k, (name, _) in enumerate(licenses.TEMPLATES):
        assert want[first + 3 * k + 1, name][1] > 0.99 and want[first + 3 * k + 2, name][1] > 0.99


@pytest.mark.parametrize("text, name", [("Copyright 2020 Jane Roe. Released under the MIT License.", "MIT"), ("This code is free to use. Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("# SPDX-License-Identifier: BSD-3-Clause\nimport os", "BSD-3-Clause"), ("A licence of our own, see the file", None)])
def test_licenses_within_a_line(spark, text, name):
    got = licenses.scan(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()
    assert [(r["license"], r["dice"]) for r in got] == ([(name, 1.0)] if name else [])


# --- simhash


def brute_print(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_match_the_definition(spark):
    for r in simhash.near_duplicates(odd(spark)).join(odd(spark).select("doc_id", "text").distinct(), "doc_id").collect():
        assert int(r["fingerprint"], 16) == brute_print(r["text"])


@pytest.mark.parametrize("windows", [1, 2])
def test_close_pairs_share_an_anchor(windows):
    rng = random.Random(windows)
    for _ in range(400):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 2)):
            y ^= 1 << b
        at, anchor = simhash.anchors_of(np.array([x, y], np.uint64).view(np.int64), windows)
        assert set(anchor[at == 0]) & set(anchor[at == 1])


@pytest.mark.parametrize("block", [4096, 8])
def test_links_join_all_close_fingerprints(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(9)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(30):
            fps.add(x)
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.4:
                x ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
    f = np.array(sorted(fps), np.uint64)
    want = common.forest(((i, np.flatnonzero(np.bitwise_count(f[i] ^ f) <= 2)) for i in range(len(f))), len(f))
    df = spark.createDataFrame([(simhash._signed(int(x)),) for x in f], "fp long")
    got = dict(common.components(simhash.links(df, 1), common.Scratch(spark, "t")).collect())
    label = [got.get(simhash._signed(int(x)), simhash._signed(int(x))) for x in f]
    assert len(set(zip(want.tolist(), label))) == len(set(want.tolist())) == len(set(label))


def test_copies_and_near_copies_form_components(spark):
    rng = random.Random(3)
    a, b = (" ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(300)) for _ in range(2))
    df = spark.createDataFrame([(5, a), (3, a), (9, b), (7, b.upper()), (1, None), (2, " ")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert got == {5: 3, 3: 3, 9: 7, 7: 7, 1: 1, 2: 1}
    assert sorted(r["doc_id"] for r in simhash.deduplicate(df).collect()) == [1, 3, 7]
