import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradelens.llm import decontam, language, pii, toxicity, url_rules
from gradelens.llm.bilstm_crf import BiLstmCrf
from llm.conftest import ODD, long_text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def _brute_hits(texts, items):
    wins = {}
    for item, t in items:
        w = WORD.findall(_ascii_lower(t))
        for i in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[i:i + 10]), set()).add(str(item))
    out = []
    for d, t in enumerate(texts):
        w, hit, names = WORD.findall(_ascii_lower(t)), set(), set()
        for size in {len(x) for x in wins}:
            for i in range(len(w) - size + 1):
                found = wins.get(tuple(w[i:i + size]))
                if found:
                    hit.update(range(i, i + size))
                    names |= found
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def _benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("shard", [1 << 20, 60])
def test_hits_equal_brute_force(make, spark, shard):
    items = [(1, long_text(30, 1)), (12, long_text(12, 2)), (2, "Short ITEM here"), (3, None), (4, "..."), (5, long_text(12, 2)), (6, "É x")]
    a = items[0][1].split()
    texts = ODD + [" ".join(a[3:17]), " ".join(a[3:12]), "pre " + items[1][1].upper() + ", post short, item; HERE.", "é x É X", "x " + items[0][1] + " " + items[0][1], "short item short item here"]
    hit = decontam.find(make(texts).select("doc_id", "text"), _benchmark(spark, items), shard_bytes=shard)
    got = sorted((r["doc_id"], r["_hit"]["n_words"], len(r["_hit"]["hit"]), len(r["_hit"]["items"]), decontam.items_digest(r["_hit"]["items"]), bool(r["_hit"]["hit"])) for r in hit.collect())
    assert got == _brute_hits(texts, items)


@pytest.mark.parametrize("shard", [1 << 20, 200])
def test_long_items_in_pieces_and_shared_windows(make, spark, monkeypatch, shard):
    monkeypatch.setattr(decontam, "PIECE", 7)
    monkeypatch.setattr(decontam, "SLICE_BYTES", 50)
    common = long_text(11, 40)
    items = [(1, long_text(95, 41)), (2, long_text(20, 42) + " " + common), (3, common), (10, common), (4, None), (None, long_text(30, 43)), (5, "")]
    a = items[0][1].split()
    texts = [" ".join(a[i:i + k]) for i in range(0, 90, 5) for k in (9, 10, 13)] + [items[1][1], f"x {common} y {common}", long_text(30, 43), " ".join(a), " ".join(a), None]
    hit = decontam.find(make(texts).select("doc_id", "text"), _benchmark(spark, items), shard_bytes=shard)
    got = sorted((r["doc_id"], r["_hit"]["n_words"], len(r["_hit"]["hit"]), len(r["_hit"]["items"]), decontam.items_digest(r["_hit"]["items"]), bool(r["_hit"]["hit"])) for r in hit.collect())
    assert got == _brute_hits(texts, [x for x in items if x[0] is not None])


def test_empty_tables_and_removal(make, spark):
    none = _benchmark(spark, [])
    assert {r["contaminated"] for r in decontam.report(make(["a b"]), none).collect()} == {False}
    item = long_text(10, 7)
    docs = make([f"clean text", f"Before. {item}, after it.", None, "clean text"]).withColumn("hit", F.lit(1))
    bench = _benchmark(spark, [(1, item)])
    assert decontam.report(make([]), bench).count() == 0
    assert sorted(r["doc_id"] for r in decontam.remove(docs, bench).collect()) == [0, 2, 3]
    spans = {r["doc_id"]: r["text"] for r in decontam.remove(docs, bench, spans=True, most=1.0).collect()}
    assert spans == {0: "clean text", 1: "Before. , after it.", 2: None, 3: "clean text"} and decontam.remove(docs, bench).columns == docs.columns


def _pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))


def test_url_parts_and_fixed_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?y#z", "http://example.net/EN/", "http://x.net", "http://x.net/", "ftp://b.example.com/de/1",
            "http://xexample.com/de/1", "http://org/fr/", "http://fakeorg/fr/", "http://a.org/fr", "h://a.org/fr/#/x", "x://y.net?a/b", "http://a://b.net/", "http://É.NET/é"]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_rules.judge(_pages(spark, urls)).collect()}

    def brute(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = _ascii_lower(re.match(r"[^/?#]*", rest).group())
        path = re.match(r"[^/?#]*([^?#]*)", rest).group(1)
        fit = [h + p for _, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fit, key=len, default=None)

    assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert url_rules.judge(_pages(spark, []).where("false")).count() == 0


def _brute_rules(labelled, support, confidence):
    """All rules on at most one token of each class that no rule on fewer tokens beats: ``{(tokens, verdict): (confidence, support)}``."""
    n, least = len(labelled), max(2, int(support * len(labelled)))
    where = {}
    for i, (toks, _) in enumerate(labelled):
        for t in toks:
            where.setdefault(t, set()).add(i)
    classes = {}
    for t, rows in where.items():
        if len(rows) >= least:
            classes.setdefault(frozenset(rows), []).append(t)
    found, level = {}, [((), frozenset(range(n)))]
    order = sorted(classes, key=lambda c: min(classes[c]))
    while level:
        longer = []
        for chosen, rows in level:
            for k in range(chosen[-1] + 1 if chosen else 0, len(order)):
                both = rows & order[k]
                if len(both) >= least:
                    longer.append(((*chosen, k), both))
        for chosen, rows in longer:
            for v in {v for _, v in labelled}:
                m = sum(labelled[i][1] == v for i in rows)
                if m >= least and m / len(rows) >= confidence:
                    found[frozenset(chosen), v] = (m / len(rows), m / n)
        level = longer
    return {(frozenset(min(classes[order[k]]) for k in chosen), v): x for (chosen, v), x in found.items()
            if not any(less < chosen and w == v and c >= x[0] for (less, w), (c, _) in found.items())}, {t: min(c) for c in classes.values() for t in c}


def _rules_of(mined):
    return {(frozenset(r["items"]), r["verdict"]): (r["confidence"], r["support"]) for r in mined.rules.collect()}


@pytest.mark.parametrize("support,confidence", [(0.05, 0.8), (0.02, 0.6)])
def test_mined_rules_equal_brute_force(spark, support, confidence):
    rng = random.Random(5)
    urls = [f"http://{rng.choice(['m', 'www'])}.{rng.choice(['a', 'b', 'ads'])}.example.{rng.choice(['net', 'org', 'com'])}/{rng.choice(['en', 'de', 'fr'])}/{rng.randrange(9)}?{rng.choice(['ref', 'page'])}=1" for _ in range(400)]
    urls += urls[:100]
    parsed = url_rules.parse(_pages(spark, urls).select("page_id", "url")).withColumn("r", url_rules.fixed_rule()).withColumn("toks", url_rules.tokens())
    labelled = [(frozenset(r["toks"]), r["r"]["verdict"]) for r in parsed.where("r is not null").select("url", "toks", "r").distinct().collect()]
    mined = url_rules.mine(spark.createDataFrame([(sorted(t), v) for t, v in labelled], "toks array<string>, label string"), support, confidence)
    got, (want, items) = _rules_of(mined), _brute_rules(labelled, support, confidence)
    assert got.keys() == want.keys() and got                       # none lost, none too many
    assert all(got[k] == pytest.approx(want[k]) for k in got)
    assert {r["tok"]: r["item"] for r in mined.items.collect()} == items
    open_ = parsed.where("r is null").select("url", "toks").distinct()
    verdicts = {r["url"]: r["mined"] for r in url_rules.match(open_, mined).collect()}
    for r in open_.collect():
        held = {items[t] for t in r["toks"] if t in items}
        fit = [(c, s, v) for (need, v), (c, s) in got.items() if need <= held]
        assert verdicts.get(r["url"]) == (max(fit)[2] if fit else None)


def test_rules_on_urls_of_many_tokens(spark):
    deep = [f"p:{i:02d}" for i in range(25)]
    rows = [(deep + ["q:bad"], "block")] * 20 + [(deep + ["q:good"], "allow")] * 20 + [(deep, "allow")] * 60 + [(deep[:9] + ["q:bad", "p:x"], "allow")] * 2
    mined = url_rules.mine(spark.createDataFrame(rows, "toks array<string>, label string"), 0.05, 0.8)
    rules, items = _rules_of(mined), {r["tok"]: r["item"] for r in mined.items.collect()}
    assert rules[frozenset(["q:bad"]), "block"] == (20 / 22, 20 / 102) and rules[frozenset(["q:good"]), "allow"] == (1.0, 20 / 102)
    assert {items[t] for t in deep[:9]} == {deep[0]} and {items[t] for t in deep[9:]} == {deep[9]}
    assert {t for t, v in rules if v == "block"} == {frozenset(["q:bad"]), frozenset(["q:bad", deep[9]])}
    urls = spark.createDataFrame([("u", deep + ["q:bad"]), ("v", ["q:bad", deep[20]]), ("w", ["p:none"])], "url string, toks array<string>")
    assert {r["url"]: r["mined"] for r in url_rules.match(urls, mined).collect()} == {"u": "block", "v": "block"}


def test_viterbi_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(100):
        first = np.concatenate([[0], np.cumsum(rng.integers(0, 70, 5))])
        s = rng.normal(0, 3, (first[-1], 4)).astype(np.float32)
        got = language.viterbi(s, first, 2.5, block=8)
        for a, b in zip(first, first[1:]):
            if b > a:
                f = s[a].astype(float)
                for t in range(a + 1, b):
                    f = (f[:, None] - 2.5 * (1 - np.eye(4))).max(0) + s[t]
                lab = got[a:b]
                assert abs(s[a:b][np.arange(b - a), lab].sum() - 2.5 * (np.diff(lab) != 0).sum() - f.max()) < 1e-2


def _tongue(seed, letters, words=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(words))


def test_languages_scripts_and_spans(make, spark):
    rows = [(i, _tongue(i, "aeioumnl"), "aa") for i in range(30)] + [(100 + i, _tongue(i, "bcdfgrst"), "bb") for i in range(30)] + [(200 + i, _tongue(i, "абвгде"), "cc") for i in range(30)]
    docs = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string, score int")
    model = language.fit(docs, ~language.held_out())
    assert model.languages == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == want and 0 < got[i]["score"] <= 1 for i, _, want in rows)
    mixed = _tongue(1, "aeioumnl", 30) + " " + _tongue(2, "bcdfgrst", 50) + " " + _tongue(3, "абвгде", 20)
    spans = model.spans(mixed)
    assert [k for _, _, k in spans] == ["aa", "bb", "cc"] and mixed[spans[2][0]:spans[2][1]] == _tongue(3, "абвгде", 20)
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(make(ODD + ["中文", mixed]), model).collect()}
    assert all(odd[i] == ("und", 0.0) for i in (0, 1, 2, 3)) and odd[len(ODD) + 1][0] == "bb"
    assert odd[len(ODD)][0] in model.languages                  # letters of a script that no language uses
    assert all(k in model.languages for _, (k, _) in odd.items() if k != "und")
    empty = language.fit(make([]))
    assert empty.languages == [] and {r["lang_pred"] for r in language.predict(make(ODD), empty).collect()} == {"und"}


def test_many_languages_are_all_learned(spark, monkeypatch):
    """Letters of their own for every language: each must be learned, however many there are."""
    monkeypatch.setattr(language, "FEW_LANGUAGES", 8)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 250 * 3)]
    rows = [(i, " ".join("".join(random.Random(i + 1000 * k).choices(letters[3 * i:3 * i + 3], k=6)) for k in range(8)), f"l{i:03d}") for i in range(250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language.fit(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, model).collect()}
    assert len(model.languages) == 250 and all(got[i] == lang for i, _, lang in rows)


BAD = ["vilefool", "grossnit", "dumbclod"]


def _toxic_corpus(spark, n=400):
    rng = random.Random(2)
    vocabulary = long_text(500, 77).split()
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        bad = i % 3 == 0
        for _ in range(4 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(BAD))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_documents(spark, make):
    docs, labels = _toxic_corpus(spark)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = toxicity.report(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 40 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) >= 0.95
    model = toxicity.fit(docs, labels)
    kept = {r["doc_id"] for r in toxicity.reject(docs.withColumn("_toxicity", F.lit(1)), model).collect()}
    assert len(kept & {i for i, t in truth.items() if t}) <= 6 and len(kept & {i for i, t in truth.items() if not t}) >= 255
    odd = toxicity.reject(make(ODD), model)
    assert odd.columns == make([]).columns and 0 in {r["doc_id"] for r in odd.collect()}


def test_limit_keeps_the_stated_share_of_ordinary_documents():
    model = toxicity.ToxicModel(["bad words"] * 9, ["good words"] * 9)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["bad", "good", "words", "more", "less"]) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    labels = [int(i % 10 == 0) for i in range(300)]
    model.calibrate(texts, labels, 0.1)
    under = [model.score(t) < model.limit for t, y in zip(texts, labels) if not y]
    assert toxicity.KEEP_ORDINARY <= sum(under) / len(under) and model.limit < 1


def test_toxicity_without_labels(spark, make):
    docs, labels = _toxic_corpus(spark, 20)
    for some, want in ((labels.where("false"), 0.0), (labels.where("toxic = 1"), 1.0), (labels.withColumn("toxic", F.lit(None).cast("int")), 0.0)):
        assert {r["score"] for r in toxicity.report(docs, some).collect()} == {want}
    assert toxicity.report(make([]), labels).count() == 0


def _labelled(n, insert, seed=4):
    rng = random.Random(seed)
    vocabulary = long_text(300, 78).split()
    out = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(30, 90))]
        at = rng.randrange(len(w))
        w[at:at] = insert(rng, i % 2)
        out.append((" ".join(w), i % 2))
    return out


def test_toxicity_by_many_words_each_rare():
    words = [long_text(2, 500 + i).replace(" ", "") + "w" for i in range(60)]
    often = "vilefool"
    docs = _labelled(2400, lambda rng, bad: [*rng.sample(words, 2), often] if bad else [])
    model = toxicity.ToxicModel([t for t, y in docs if y], [t for t, y in docs if not y])
    assert sum(d > 0 for d, _ in model.distances(words)) >= 30


def test_toxicity_by_a_phrase_of_ordinary_words():
    phrase = long_text(300, 78).split()[40:52]
    docs = _labelled(900, lambda rng, bad: phrase if bad else rng.sample(phrase, len(phrase)))
    model = toxicity.ToxicModel([t for t, y in docs[:600] if y], [t for t, y in docs[:600] if not y])
    model.calibrate([t for t, _ in docs[600:750]], [y for _, y in docs[600:750]], 0.5)
    assert sum((model.score(t) >= 0.5) == bool(y) for t, y in docs[750:]) / 150 >= 0.9


def _brute_base(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(0)
    parts = ["a", "b.c", "@", "@x.y", ".", "-", " ", "+", "+1", "12", "255", "256", "1.2.3.4", "1.2.3.4.5", "0007", "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1112", "(555) 555-0100", "é", "中", "_%", "\n"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        assert pii.base_spans(t) == _brute_base(t), t
    big = "9" * 200_000 + "a" * 200_000 + "1 " * 100_000 + "." * 100_000 + "a@b.c"
    assert [s[0] for s in pii.base_spans(big)] == ["email"]


def test_network_gradients():
    net = BiLstmCrf(5, 3, 4)
    x, y = np.random.default_rng(0).integers(0, 5, (3, 6)), np.random.default_rng(1).integers(0, 3, (3, 6))
    _, g = net.loss(x, y)
    for k, p in net.p.items():
        i = tuple(0 for _ in p.shape)
        p[i] += 1e-5
        up = net.loss(x, y)[0]
        p[i] -= 2e-5
        down = net.loss(x, y)[0]
        p[i] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][i]) < 1e-4


def _personal(seed):
    rng = random.Random(seed)
    kind = rng.choice(["email", "ip", "phone"])
    s = {"email": f"{long_text(1, seed)}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", "ip": ".".join(str(rng.randrange(256)) for _ in range(4)),
         "phone": f"+1 ({rng.randrange(100, 999)}) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"}[kind]
    return f"{long_text(rng.randint(5, 60), seed)} {s} {long_text(rng.randint(5, 60), seed + 1)}"


def test_network_learns_the_labelled_spans_and_masks(make):
    texts = [_personal(i) for i in range(500)]
    model = pii.PiiModel(texts[:400])
    found = total = 0
    for t, got in zip(texts[400:], model._tagged(texts[400:])):
        found += len(set(_brute_base(t)) & set(got))
        total += len(_brute_base(t))
    assert found / total >= 0.85
    docs = make(texts[400:440] + ODD)
    rows = {r["doc_id"]: r for r in pii.report(docs, model).collect()}
    for i, t in enumerate(texts[400:440] + ODD):
        base = _brute_base(t)
        assert rows[i]["base_sha256"] == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert set(pii.written(base).split(",")) <= set(rows[i]["spans"].split(","))
        assert sum(rows[i][f"n_{k}"] for k in pii.KINDS) == len(base)
    masked = {r["doc_id"]: r["text"] for r in pii.mask(docs, model).collect()}
    assert all(not _brute_base(t) for t in masked.values()) and masked[40] is None and masked[41] == ""
    assert pii.report(make([])).count() == 0


def test_masking_joins_overlapping_spans():
    assert pii.masked("call +1 555 now", [("phone", 5, 11), ("card", 6, 11)]) == "call [PHONE] now"


def test_tagged_spans_are_trimmed_to_what_is_new():
    text = "call  +1 555 010 9999  or 192.168.10.1234567890 x"
    assert pii.outside(("phone", 4, 23), [], text) == [("phone", 6, 21)]                       # blanks at the ends
    assert pii.outside(("phone", 6, 30), [("phone", 6, 21)], text) == []                       # what is left is too short
    assert pii.outside(("phone", 0, len(text)), [("phone", 6, 21)], text) == [("phone", 23, len(text))]
    assert pii.outside(("card", 0, 5), [], text) == [] and pii.outside(("email", 0, 0), [], text) == []
    both = pii.outside(("phone", 0, 30), [("x", 10, 15)], "0123456789     0123456789abcde")
    assert both == [("phone", 0, 10), ("phone", 15, 30)]


def test_training_windows_hold_every_kind():
    plenty = ["reach me at someone@example.com or " + "1 2 3 4 " * 300 for _ in range(40)]
    rare = ["my card 4111 1111 1111 1111 is", "server 10.0.0.1 here", "ring +44 20 7946 0958 now"]
    texts = plenty + rare
    tagged = []
    for t in texts:
        tags = np.zeros(len(t) + pii.WINDOW, np.int8)
        for kind, a, b in pii.base_spans(t):
            tags[a:b] = pii.KINDS.index(kind) + 1
        tagged.append(tags)
    places = [(d, s) for d, t in enumerate(texts) for s in pii.starts_of(t)]
    got = pii._chosen(places, tagged, texts, most=200)
    assert len(got) == len(set(got)) == 200 < len(places)
    assert {int(k) for d, s in got for k in tagged[d][s:s + pii.WINDOW]} == {0, 1, 2, 3, 4}
    assert pii._chosen(places, tagged, texts, most=10 ** 6) and set(pii._chosen(places, tagged, texts, most=10 ** 6)) == set(places)


def test_benchmark_columns_of_clashing_names_stay(spark):
    docs = spark.createDataFrame([(1, "a clean text", 5, 6, 7), (2, " ".join(f"w{i}" for i in range(12)), 8, 9, 10)], "doc_id long, text string, _hit0 int, _hit int, _HIT_ int")
    items = _benchmark(spark, [(1, " ".join(f"w{i}" for i in range(10)))])
    for spans in (False, True):
        got = decontam.remove(docs, items, spans=spans)
        assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [tuple(docs.first())]
    many = decontam.find(docs, items.unionByName(_benchmark(spark, [(2, "other words here")])), shard_bytes=5)
    assert many.columns[:-1] == docs.columns and many.where("doc_id = 2").first()[-1]["items"] == ["1"]


def test_toxicity_keeps_what_a_worker_knows_of_words(monkeypatch):
    """Tasks of one worker share the distances of words; when there are many, those not met again are forgotten."""
    import pickle
    model = toxicity.ToxicModel(["bad words here"] * 9, ["good words there"] * 9)
    one, two = pickle.loads(pickle.dumps(model)), pickle.loads(pickle.dumps(model))
    assert toxicity._loaded(one, b"a") is one and toxicity._loaded(two, b"a") is one
    assert toxicity._loaded(two, b"b") is two and toxicity._loaded(one, b"a") is one
    texts = [" ".join(f"w{i * j}x" for j in range(1, 9)) + " bad" for i in range(1, 30)]
    want = [model.features(t) for t in texts]
    monkeypatch.setattr(toxicity, "KEEP_WINDOWS", 20)
    assert [two.features(t) for t in texts * 2] == want * 2
    assert "bad" in two._kept and len(two._kept) + len(two._older) <= 40
