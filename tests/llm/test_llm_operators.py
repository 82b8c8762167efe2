"""Operators of the training-data subpackage against brute force, round trips and held-out labels."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

LONG = "word " * 30_000 + "tail"
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. It was not amused!"),
    (2, "the quick  brown fox jumps over the lazy dog. it was not amused!"),
    (3, None),
    (4, ""),
    (5, " \t\n"),
    (6, "Größe 12 x 3 = ½ µ; naïve café's they'll \u4e2d\u6587 \U0001f600 <|endoftext|>"),
    (7, LONG),
    (8, LONG),
    (9, "one"),
    (10, "a b c d"),
    (11, "line\r\n\r\nWARC/1.1\r\nline [INST] \\ <s> [/INST] ]"),
    (12, "The quick brown fox jumps over the lazy dog. It was not amused!"),
    (12, "The quick brown fox jumps over the lazy dog. It was not amused!"),
    (None, "The quick brown fox jumps over the lazy dog."),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, blanks, a long text, repeated rows, and columns whose names the operators use inside."""
    rows = [(i, t, "en", "src", 5, "x", 1) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, uid int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# SimHash


def plain_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_fingerprints_follow_the_definition():
    from quarry.llm.simhash import fingerprint

    for _, text in TEXTS:
        text = text and text[:2000]
        assert fingerprint(text) == plain_fingerprint(text)


def plain_components(fps, distance):
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= distance:
                up[root(a)] = root(b)
    return {f: root(f) for f in fps}


@pytest.mark.parametrize("block", [3, 4096])
@pytest.mark.parametrize("plan", [((0, 21, 1), (21, 21, 1), (42, 22, 0)), ((0, 32, 2), (32, 32, 1))])
def test_links_connect_what_all_pairs_connect(spark, plan, block):
    from quarry.llm.components import connected_components
    from quarry.llm.simhash import links

    rng = np.random.default_rng(1)
    fps = set(rng.integers(0, 1 << 63, 60).tolist())
    for f in list(fps)[:12]:
        for _ in range(6):
            g = f
            for b in rng.choice(63, rng.integers(1, 7), replace=False):
                g ^= 1 << int(b)
            fps.add(g)
    want = plain_components(fps, 4)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r["node"]: r["root"] for r in connected_components(links(df, plan=plan, block=block), "a", "b").collect()}
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert {g for g in groups(want) if len(g) > 1} == groups(got)


def test_near_duplicates_over_edge_cases(docs, empty):
    from quarry.llm.simhash import near_duplicates

    rows = near_duplicates(docs).collect()
    assert len(rows) == len(TEXTS)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["component_id"] == by[2]["component_id"] == by[12]["component_id"] == 1
    assert by[3]["fingerprint"] == by[4]["fingerprint"] == by[5]["fingerprint"] == "0" * 16
    assert by[3]["component_id"] == by[5]["component_id"] == 3
    assert by[8]["component_id"] == 7 and by[9]["component_id"] == 9
    assert near_duplicates(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    from quarry.llm.components import connected_components

    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100} | {200 + i: 100 for i in range(30)}


# Toxicity


def test_noisy_or_learns_sentences_from_documents(spark, docs, empty):
    from quarry.llm import toxicity as T

    rng = np.random.default_rng(2)
    clean = [f"term{k}x" for k in "abcdefghijklmnopqrstuvwxyz"]
    texts, labels = [], []
    for i in range(400):
        sents = [" ".join(rng.choice(clean, 8)) for _ in range(6)]
        labels.append(int(i % 4 == 0))
        if labels[-1]:
            sents[int(rng.integers(6))] += " nastyword"
        texts.append(". ".join(sents) + ".")
    scorer = T.Scorer(*T.fit(texts[:300], labels[:300]))
    assert all((scorer.score(t) >= 0.5) == bool(y) for t, y in zip(texts[300:], labels[300:], strict=True))
    spot = scorer.locate("terma termb. This nastyword here. termc.")
    assert len(spot) == 1 and spot[0]["first"] == 12
    assert scorer.score(None) == scorer.score("") == scorer.score("...") == 0.0
    known = spark.createDataFrame([(i, 1, i % 2) for i in range(13)] + [(2, 1, 1), (None, 1, None)], "doc_id long, quality int, toxic int")
    rows = T.toxicity(docs, known).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"] is not None)
    assert T.toxicity(empty, known.limit(0)).count() == 0


def test_noisy_or_by_its_definition():
    """Scores from the formula with plain loops; the gradient against differences of the loss; spans from
    the words that scores count."""
    import re as plain
    from math import exp, prod

    from quarry.llm import toxicity as T

    rng = np.random.default_rng(9)
    w, bias = rng.normal(0, 0.8, T.BUCKETS).astype(np.float32), -2.0
    scorer = T.Scorer(w, bias)
    texts = ["One two. Three four five! six", "İstanbul İzmir. ΟΔΟΣ straße", "x " * 95 + ". y", "", "...", "a\nb?c"]
    for text in texts:
        ps = []
        for sentence in plain.split(r"[.!?\n]", text):
            words = [x.lower() for x in plain.findall(r"[^\W\d_]+", sentence)]
            for k in range(0, len(words), T.SPAN):
                z = sum(float(w[b]) for x in set(words[k : k + T.SPAN]) for b in T.features(x)) + bias
                ps.append(1 / (1 + exp(-z)))
        assert scorer.score(text) == pytest.approx(1 - prod(1 - p for p in ps), abs=1e-5)
        spans = scorer.locate(text, least=0.0)
        assert [s["p"] for s in spans] == pytest.approx(ps, abs=1e-5)
        assert all(0 <= s["first"] < s["end"] <= len(text) for s in spans)
    x, sent, doc, y = np.array([1, 2, 3, 1, 4]), np.array([0, 0, 1, 2, 2]), np.array([0, 1, 1]), np.array([1.0, 0.0])
    few = rng.normal(0, 0.5, 6)
    loss, gw, gb = T.gradient(few, -1.0, x, sent, doc, y, (1.0, 2.0))
    for k in range(6):
        up, down = few.copy(), few.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        assert (T.gradient(up, -1.0, x, sent, doc, y, (1.0, 2.0))[0] - T.gradient(down, -1.0, x, sent, doc, y, (1.0, 2.0))[0]) / 2e-5 == pytest.approx(gw[k], abs=1e-6)
    assert (T.gradient(few, -1.0 + 1e-5, x, sent, doc, y, (1.0, 2.0))[0] - T.gradient(few, -1.0 - 1e-5, x, sent, doc, y, (1.0, 2.0))[0]) / 2e-5 == pytest.approx(gb, abs=1e-6)


def test_toxicity_fits_on_what_is_there(spark, monkeypatch):
    from quarry.llm import toxicity as T

    long = "fine words here. " * 4_000  # over 50,000 characters
    rows = [(i, ("bad stuff. " if i % 2 else "") + (long if i % 3 == 0 else f"some text {i}.")) for i in range(60)] + [(60, None), (61, "12")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(-500, 62)], "doc_id long, quality int, toxic int")  # most have no document
    monkeypatch.setattr(T, "MOST_OF_CLASS", {1: 20, 0: 20})
    texts, ys, weights = T.sample(docs, labels)
    there = {y: sum(i % 2 == y and zlib.crc32(str(i).encode()) % 5 != 0 for i in range(60)) for y in (0, 1)}
    assert ys.count(0) == ys.count(1) == 20 and any(len(t) > 50_000 for t in texts)
    assert weights[0] / weights[1] == pytest.approx(there[0] / there[1])
    none = spark.createDataFrame([(99, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels.limit(0), none):
        assert {r["predicted"] for r in T.toxicity(docs, known).collect()} == {0}


# URL filters


def test_urls_rules_and_aliases(spark):
    from quarry.llm.urlfilter import filter_urls

    link = '<html><head><LINK href="{}" rel="canonical"></head>'
    pages = [
        (1, "http://www.Example.NET/en/x?q", "", "www.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "https://a.example.net/fr/", "", "a.example.net", "/fr/", "net/", "block"),
        (3, "https://b.example.org/fr/1", "", "b.example.org", "/fr/1", "org/fr/", "allow"),
        (4, None, None, "", "", None, "allow"),
        (5, "no scheme", "", "", "", None, "allow"),
        (6, "http://Planet#x", "", "planet", "", None, "allow"),
        (7, "http://notexample.com/de/", "", "notexample.com", "/de/", None, "allow"),
        (8, "http://copy.com/1#a", link.format("http://q.example.com/de/9"), "copy.com", "/1", None, "block"),
        (9, "http://more.com/2", link.format("//copy.com/1"), "more.com", "/2", None, "block"),
        (10, "http://mix.com/3", link.format("http://x.net/"), "mix.com", "/3", None, "allow"),
        (11, "http://s.org/fr/z", '<meta http-equiv=refresh content="0; url=http://mix.com/3">', "s.org", "/fr/z", "org/fr/", "allow"),
        (12, "http://copy.com/1", "", "copy.com", "/1", None, "block"),
        (12, "http://copy.com/1", "", "copy.com", "/1", None, "block"),
        (13, "http://net", "", "net", "", None, "allow"),
        (14, "a://b://c.net/x", "", "b:", "//c.net/x", None, "allow"),
    ]
    df = spark.createDataFrame([(*p[:3], "junk") for p in pages], "page_id long, url string, html string, address string")
    got = sorted(tuple(r) for r in filter_urls(df).collect())
    assert got == sorted((p[0], *p[3:]) for p in pages)
    assert filter_urls(df.limit(0)).count() == 0
    moved = spark.createDataFrame([("http://notexample.com/de/", "http://z.net/")], "src string, dst string")
    assert {r["page_id"]: r["verdict"] for r in filter_urls(df, redirects=moved).collect()}[7] == "block"


def test_links_of_pages():
    from quarry.llm.urlfilter import _targets

    at = "http://h.org/a/b?c"
    cases = [
        ('<link title="' + "x" * 5000 + '" rel=canonical href="http://d.net/">', ["http://d.net/"]),
        ("<link title='a > b' rel='alternate CANONICAL' href=/x>", ["http://h.org/x"]),
        ('<LINK HREF="http://b.net/?u=1&amp;v=2" rel="canonical"/>', ["http://b.net/?u=1&v=2"]),
        ('<!-- <link rel=canonical href="http://no.net/"> --><link rel=canonical href=y>', ["http://h.org/a/y"]),
        ('<script>"<link rel=canonical href=http://no.net/>"</script ><style></style><link rel=canonical href=../z>', ["http://h.org/z"]),
        ("<title><link rel=canonical href=http://no.net/></title>", []),
        ('<base href="//o.net/q/"><link rel=canonical href=r>', ["http://o.net/q/r"]),
        ('<meta content="0; URL=\'http://m.net/1 2\'" http-equiv=Refresh>', ["http://m.net/1 2"]),
        ('<meta http-equiv="refresh" content="5; url=http://late.net/">', []),
        ("<link rel=canonical><link rel=canonical href=''><link rel=canonical href='javascript:x'><linkage rel=canonical href=q>", []),
        ("<link rel=canonical href='http://[bad/'><link rel=canonical href='http://cut.net/", []),
        ("<link " + "a='b' " * 20_000 + "rel=canonical href=http://long.net/>", ["http://long.net/"]),
        ("<!-- <link rel=canonical href=http://no.net/>", []),
    ]
    for html, want in cases:
        assert _targets(at, html) == want, html[:80]


def test_url_query_and_its_sql_over_pages_with_links(spark, tmp_path):
    import duckdb

    from quarry.llm.urlfilter import OP3_SQL, op3_url_filters

    rng = np.random.default_rng(6)
    hosts = ["A.example.com", "b.example.net", "c.org", "d.net", "e.info", "f.info", "G.info"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/1", "/fr/2", "/de/3?q=1", "/x#frag", "/deep/er/4")]
    kinds = ['<link rel="canonical" href="{}">', "<LINK href='{}' REL=canonical>", '<meta http-equiv="refresh" content="0;url={}">', '<!-- <link rel="canonical" href="{}"> -->', '<link rel="icon" href="{}">']
    rows = []
    for i in range(300):
        url = urls[rng.integers(len(urls))]
        to = [*urls, "/en/9", "9", "//d.net/fr/", "/p?a=1&amp;b=2", "mailto:x"][rng.integers(len(urls) + 5)]
        rows.append((i, url, "<html>" + kinds[rng.integers(5)].format(to) if rng.random() < 0.15 else "<html>"))
    rows += [(300, None, None), (301, "no scheme", "<link rel=canonical href=http://d.net/>"), (302, "http://x.info/1", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(map(str, duck.sql(OP3_SQL).fetchall()))
    got = op3_url_filters(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(str(tuple(r)) for r in got) == want
    by_rule = sum(r["rule"] is None and r["verdict"] == "block" for r in got)
    assert by_rule > 3  # some verdicts come from aliases alone


# Media


def test_media_round_trip(docs, empty):
    from quarry.llm import media as M

    rows = M.features(M.media_column(docs)).collect()
    assert len(rows) == len(TEXTS) and M.features(M.media_column(empty)).count() == 0
    texts = {i: t for i, t in TEXTS}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert r["n_bytes"] == len(raw) and r["payload_bytes"] == len(payload)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert r["codec"] == "raw " and r["n_samples"] == len(payload) // 192 and r["duration"] == pytest.approx(r["n_samples"] / 25)
        keys = -(-r["n_samples"] // M.SYNC_EVERY)
        assert r["n_keyframes"] == keys and sum(k["end"] - k["first"] for k in r["keyframes"]) == 192 * keys and r["n_tracks"] == 1


def test_media_tables_of_keyframes_and_damage():
    from quarry.llm import media as M

    payload = bytes(range(192)) * 50
    data = M.write_container(payload, sync_every=12, chunk_frames=7)
    (t,) = M.read_container(data)
    assert t["keys"].tolist() == [0, 12, 24, 36, 48] and t["decoded"] == t["duration"] == 50
    spans = M.ranges(t["starts"][t["keys"]], t["sizes"][t["keys"]])
    assert [data[a:b] for a, b in spans] == [payload[192 * k : 192 * k + 192] for k in t["keys"]]
    assert [b"/".join(p) for p, _, _ in M.walk(memoryview(data))][-1] == b"moov/trak/mdia/minf/stbl/stco"
    with pytest.raises(ValueError):
        M.read_container(data[:-5])


def test_media_of_other_writers(spark):
    """A file of sound and pictures, uneven samples, compact sizes; no file; a fragmented one."""
    import struct

    from quarry.llm import media as M

    data = M.write_container(bytes(192 * 30), sync_every=10)
    at = data.index(b"moov") - 4
    moov = data[at:]
    trak = moov[moov.index(b"trak") - 4 :]
    sound = trak.replace(b"vide", b"soun").replace(b"raw ", b"sowt")
    both = data[:at] + M.box(b"moov", moov[8 : moov.index(b"trak") - 4], sound, trak)
    assert [t["codec"] for t in M.read_container(both)] == ["sowt", "raw "]
    sizes = [5, 9, 15, 1]  # four bits each
    four = M.full(b"stz2", struct.pack(">II", 4, 4), bytes([0x59, 0xF1]))
    stbl = M.box(b"stbl", M.full(b"stsd", struct.pack(">I", 1), M.box(b"xxxx")), M.full(b"stts", struct.pack(">IIIII", 2, 3, 2, 1, 7)), M.full(b"stsc", struct.pack(">IIII", 1, 1, 2, 1)), four, M.full(b"stco", struct.pack(">III", 2, 100, 200)), M.full(b"stss", struct.pack(">III", 2, 1, 3)))
    own = M.box(b"moov", M.box(b"trak", M.box(b"mdia", M.full(b"mdhd", struct.pack(">IIIII", 0, 0, 10, 13, 0)), M.box(b"minf", stbl))))
    (t,) = M.read_container(own)
    assert t["sizes"].tolist() == sizes and t["starts"].tolist() == [100, 105, 200, 215] and t["keys"].tolist() == [0, 2] and t["decoded"] == 13
    assert M.ranges(t["starts"], t["sizes"]) == [(100, 114), (200, 216)]
    with pytest.raises(ValueError, match="fragment"):
        M.read_container(own + M.box(b"moof"))
    rows = spark.createDataFrame([(1, 7, bytearray(both)), (2, None, None), (3, 0, bytearray(M.box(b"free")))], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in M.features(rows).collect()}
    assert got[1]["codec"] == "raw " and got[1]["n_tracks"] == 2 and got[2]["media_bytes"] is None and got[2]["codec"] is None
    assert got[3]["n_tracks"] == 0 and got[3]["codec"] is None and got[3]["media_bytes"] == 8


# Language


def test_network_gradients_are_those_of_its_loss():
    from quarry.llm.langid import Network

    net = Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = np.array([list(b" ab \0\0\0"), list(b" longer"), list(b"\0c c c ")], np.uint8).T
    mask, y = (x != 0).astype(np.float32), np.array([0, 2, 1])
    _, g = net.gradients(x, mask, y)
    rng = np.random.default_rng(0)
    for k, a in net.p.items():
        for _ in range(4):
            at = tuple(rng.integers(n) for n in a.shape) if k != "E" else (int(x[1, 1]), int(rng.integers(a.shape[1])))
            old, e = a[at], 1e-3
            a[at] = old + e
            up, _ = net.gradients(x, mask, y)
            a[at] = old - e
            down, _ = net.gradients(x, mask, y)
            a[at] = old
            assert (up - down) / (2 * e) == pytest.approx(float(g[k][at]), rel=0.08, abs=4e-4)


def test_language_over_edge_cases(spark, docs, empty):
    from quarry.llm.langid import language

    assert language(empty).count() == 0
    rng = np.random.default_rng(4)
    make = {"aa": ["kava", "lamo", "kalava"], "bb": ["trüst", "grööp", "strüpf"]}
    rows = [(i, " ".join(rng.choice(make[k], 20)), k) for i, k in enumerate(["aa", "bb"] * 60)]
    rows += [(1000, None, "aa"), (1001, "123 !? ² ½", "bb"), (1002, "", None), (1003, "kava " * 5000, None), (1004, "x" * 5000, "bb"), (None, "kava lamo", None)]
    got = {r["doc_id"]: r for r in language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[i]["lang_pred"] == k for i, _, k in rows[:120])
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == got[1002]["lang_pred"] == "und" and got[1003]["lang_pred"] == "aa"
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)


def test_languages_of_long_texts_and_many_languages_are_learned(spark, monkeypatch):
    from quarry.llm import langid as L

    rows = [(i, "kava lamo kalava", "aa") for i in range(400)]
    rows += [(1000 + i, "1 " * 60_000 + "grööp strüpf " * 5_000, "bb") for i in range(8)]  # letters after TRAIN_CHARS characters
    rows += [(2000 + i, "12 34", "cc") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with pytest.warns(UserWarning, match="cc"):
        got = L.sample(docs)
    assert set(got) == {"aa", "bb"} and all("grööp" in t and len(t) <= L.TRAIN_CHARS for t in got["bb"])
    assert len(got["bb"]) == sum(zlib.crc32(str(1000 + i).encode()) % 4 != 2 for i in range(8))
    monkeypatch.setattr(L, "MOST_LANGS", 1)
    assert set(L.sample(docs.filter("lang <> 'cc'"))) == {"aa", "bb"}


def test_windows_side_by_side_give_the_networks_own_outputs():
    """Each text alone, in one pass over all of its bytes, against windows of many texts at once."""
    from quarry.llm import langid as L

    texts = ["a", "12 Größe. " * 3, "x" * L.CORE, "हिन्दी में 12 सीखना " * 20, "word, 7 " * 100, "é" * 500]
    net = L.train([L.pool(texts[:3]), L.pool(texts[3:])], steps=3)
    lab = L.Labeller(net, ["aa", "bb"])
    lab.at_once = 5
    want = []
    for t in texts:
        raw = t.encode()
        got = lab.positions(t)
        assert got.shape == (len(raw), 2)  # every byte has a label: signs, digits and white space too
        sums = got.sum(0) / L.TEMPER
        want.append(float(np.exp(sums.max()) / np.exp(sums).sum()))
    assert [s for _, s in lab.label(texts)] == pytest.approx(want, abs=1e-4)
    alone = [lab.label([t])[0] for t in texts]
    assert alone == [(k, pytest.approx(s, abs=1e-5)) for k, s in lab.label(texts)]
    # a text of at most one core and its margins is one window: equal to the network at every position
    short = "kurz und gut, 12 mal"
    x = np.frombuffer(bytes(L.MARGIN) + short.encode() + bytes(L.MARGIN + L.CORE - len(short)), np.uint8)[:, None]
    assert np.allclose(net.log_probs(x)[L.MARGIN : L.MARGIN + len(short), 0], lab.positions(short), atol=1e-4)


# Decontamination


def plain_contamination(text, items):
    find = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, named = find(text), set(), set()
    for name, item in items:
        w = find(item)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            for s in range(len(words) - n + 1):
                if words[s : s + n] == w[i : i + n]:
                    hit.update(range(s, s + n))
                    named.add("" if name is None else str(name))
    return len(words), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [2, 500_000])
def test_decontamination_is_exact(spark, block):
    from quarry.llm.decontam import contamination, digested

    rng = np.random.default_rng(3)
    few = list("abcd") + ["Größe", "x1"]
    items = [(i, " ".join(rng.choice(few, rng.integers(1, 15)))) for i in range(6)] + [(6, None), (7, ""), (8, "c"), (9, "Größe x1 c"), (9, "zz zz"), (None, "q q q")]
    texts = [" - ".join(rng.choice(few, rng.integers(0, 60))) for _ in range(30)] + [None, "", "q,q;Q", items[0][1].upper(), "zz zz zz"]
    texts += ["x " + items[1][1] + " y " + items[2][1]] * 2
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in digested(contamination(docs, bench, block_windows=block)).collect()}
    assert got == {i: plain_contamination(t, items) for i, t in enumerate(texts)}
    assert contamination(docs.limit(0), bench).count() == 0
    assert contamination(docs, bench.limit(0)).filter("size(spans) > 0").count() == 0


# Tokens


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_memo_gives_the_library_ids(spark, name):
    from quarry.llm.bpe import Encoder, default_path

    signs = [chr(c) for c in range(0x180)] + ["\u4e2d", "\U0001f600", "'", "'s", " ", "  ", "\n", "a", "Z", "é"]
    rng = np.random.default_rng(5)
    texts = [t for _, t in TEXTS] + ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(3000)]
    latin = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(161, 256)]] + [" ", " ", "\n", "'ll", "'S"]
    texts += ["".join(rng.choice(latin, rng.integers(0, 40))) for _ in range(6000)]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    enc = Encoder(default_path(name), 7, most=3_000)
    for k in range(0, len(texts), 500):
        for text, raw in zip(texts[k : k + 500], enc.encode(texts[k : k + 500]), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == library_ids_cached(name, text, 7)


_libs = {}


def library_ids_cached(name, text, end):
    if name not in _libs:
        from tokenizers import Tokenizer

        from quarry.llm.bpe import default_path

        _libs[name] = Tokenizer.from_file(default_path(name))
        _libs[name].encode_special_tokens = True
    return [*_libs[name].encode(text or "", add_special_tokens=False).ids, end]


def test_token_store_round_trip(spark, docs, empty, tmp_path):
    from quarry.llm import tokenstore as S

    folder = S.write_store(docs, f"file://{tmp_path}/store")
    want = {}
    for i, t in TEXTS:
        want.setdefault(i, library_ids_cached("word_bpe_49k.json", t, 1))
    got = S.read_documents(spark, folder).collect()
    assert len(got) == len(TEXTS) and all(r["ids"] == want[r["doc_id"]] for r in got)
    at = 0
    rows = sorted(S.read_digests(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i))
    for r in rows:
        assert (r["start"], r["n_tokens"]) == (at, len(want[r["doc_id"]]))
        assert r["ids_crc32"] == zlib.crc32(np.array(want[r["doc_id"]], "<u4").tobytes())
        at += r["n_tokens"]
    stored = Counter(bytes(r["digest"]) for r in spark.read.parquet(f"{folder}/segments").filter("body is not null").collect())
    assert max(stored.values()) == 1
    none = S.write_store(empty, f"file://{tmp_path}/none")
    assert S.read_digests(spark, none).count() == 0


def test_store_finds_damage(spark, docs, tmp_path):
    from pyspark.sql import functions as F

    from quarry.llm import tokenstore as S

    folder = S.write_store(docs.filter("doc_id = 1"), f"file://{tmp_path}/a")
    bad = spark.read.parquet(f"{folder}/segments").withColumn("body", F.concat("body", F.lit(b"\0\0")))
    bad.write.parquet(f"file://{tmp_path}/b/segments")
    for x in ("recipes", "manifest"):
        spark.read.parquet(f"{folder}/{x}").write.parquet(f"file://{tmp_path}/b/{x}")
    with pytest.raises(Exception, match="damaged"):
        S.read_digests(spark, f"file://{tmp_path}/b").collect()


def test_store_finds_a_lost_recipe(spark, docs, tmp_path):
    from quarry.llm import tokenstore as S

    folder = S.write_store(docs.filter("doc_id < 5"), f"file://{tmp_path}/a")
    for x in ("segments", "manifest"):
        spark.read.parquet(f"{folder}/{x}").write.parquet(f"file://{tmp_path}/b/{x}")
    spark.read.parquet(f"{folder}/recipes").filter("doc_id <> 2").write.parquet(f"file://{tmp_path}/b/recipes")
    for read in (S.read_digests, S.read_documents):
        with pytest.raises(ValueError, match="manifest"):
            read(spark, f"file://{tmp_path}/b").collect()


def test_store_finds_a_changed_manifest(spark, docs, tmp_path):
    from pyspark.sql import functions as F

    from quarry.llm import tokenstore as S

    folder = S.write_store(docs, f"file://{tmp_path}/a")
    for k, (column, value) in enumerate((("root", F.lit("bad").cast("binary")), ("n_docs", F.lit(999).cast("long")), ("base", F.col("base") + 1))):
        for x in ("segments", "recipes"):
            spark.read.parquet(f"{folder}/{x}").write.parquet(f"file://{tmp_path}/{k}/{x}")
        spark.read.parquet(f"{folder}/manifest").withColumn(column, value).write.parquet(f"file://{tmp_path}/{k}/manifest")
        for read in (S.read_digests, S.read_documents):
            with pytest.raises(ValueError, match="manifest"):
                read(spark, f"file://{tmp_path}/{k}").collect()


def test_crc32_of_joined_parts():
    from quarry.llm.tokenstore import crc32_joined

    parts = [b"", b"abc", b"x" * 5000, b"\0", b"tail"]
    assert crc32_joined([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


# WARC


def test_warc_round_trip(spark, tmp_path):
    from quarry.llm import warc as W

    big = "<p>" + "ä" * 100 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"
    rows = [(5, "http://a/1", big), (3, "http://a/2", big), (9, "http://a/3", "tiny"), (4, "http://a/4", "tiny"), (7, None, None), (8, "http://x\r\ny", "z" * 100_000), (3, "http://a/2", big), (None, "http://n", big)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, uid string").repartition(3)
    folder = W.write_archives(df, f"file://{tmp_path}/warc", rows_per_file=1)
    caps = W.captures(W.records(spark, folder, payloads=True)).collect()
    assert len(caps) == len(rows) and all(c["request"] and c["response"] and c["metadata"] for c in caps)
    kinds = Counter((c["page_id"], c["response"]["kind"]) for c in caps)
    assert kinds == Counter([(3, "response"), (3, "revisit"), (5, "revisit"), (None, "revisit"), (9, "response"), (4, "response"), (7, "response"), (8, "response")])
    first = next(c for c in caps if (c["page_id"], c["response"]["kind"]) == (3, "response"))
    assert bytes(first["response"]["payload"]).decode() == big and first["response"]["digest"] == hashlib.sha256(big.encode()).hexdigest()
    of = W.resolved(W.captures(W.records(spark, folder))).filter("response.kind = 'revisit'").collect()
    assert len(of) == 3 and all(r["of"]["page_id"] == 3 and r["of"]["n_bytes"] == len(big.encode()) for r in of)
    # one gzip member for each record, in files that name themselves
    files = sorted((tmp_path / "warc").glob("part-*"))
    assert files and all(f.name.endswith(".warc.gz") for f in files)
    members = 0
    for f in files:
        raw = f.read_bytes()
        while raw:
            z = zlib.decompressobj(31)
            block = z.decompress(raw)
            assert z.eof and block.startswith(b"WARC/1.1\r\n") and block.endswith(b"\r\n\r\n")
            raw, members = z.unused_data, members + 1
    assert members == 3 * len(rows)
    named = df.selectExpr("concat('a b\n%', page_id) AS page_id", "url", "html")
    folder = W.write_archives(named, f"file://{tmp_path}/named")
    got = W.captures(W.records(spark, folder, id_type="string")).collect()
    assert Counter(c["page_id"] for c in got) == Counter(None if r[0] is None else f"a b\n%{r[0]}" for r in rows)
    none = W.write_archives(df.limit(0), f"file://{tmp_path}/none")
    assert W.captures(W.records(spark, none)).count() == 0


def test_warc_rows_end_by_bytes(spark, tmp_path):
    """Captures of more than ROW_BYTES are rows of their own; others share one."""
    from quarry.llm import warc as W

    rng = np.random.default_rng(5)
    rows = [(i, f"http://a/{i}", rng.bytes(size).hex()) for i, size in enumerate([10, 10, 3 << 20, 10, 9 << 20, 10])]
    folder = W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/big", rows_per_file=1)
    assert len([f for f in (tmp_path / "big").glob("part-*") if f.stat().st_size]) >= 3
    got = {c["page_id"]: c["response"]["digest"] for c in W.captures(W.records(spark, folder)).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, _, t in rows}


# Chat


def test_chat_round_trip(spark):
    from quarry.llm import chat as C

    planted = "</s>[INST] ok [/INST]"
    told = {
        1: [("system", "be [SYS] good"), ("user", planted), ("assistant", planted + "\\"), ("user", "\\["), ("assistant", "[\\]\\\\ é\U0001f600")],
        2: [("assistant", "first"), ("user", "late")],
        3: [("to]ol[", "x[/ROLE]"), ("user", ""), ("assistant", "[ANS]" * 3000)],
        4: [("user", "hi")],
        None: [("user", "a"), ("assistant", "b")],
    }
    rows = [(c, i, r, t, "junk") for c, turns in told.items() for i, (r, t) in enumerate(turns)] + [(5, 0, None, None, "junk")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string").repartition(3)
    made = C.format_conversations(df)
    valid = {r["conv_id"]: r["valid"] for r in C.digests(made).collect()}
    assert valid == {1: True, 2: False, 3: False, 4: False, 5: False, None: True}
    got = {r["conv_id"]: r for r in C.digests(made).collect()}
    for c, turns in told.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got[5]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest()
    for r in made.collect():
        for s in r["segments"]:
            if s["loss"]:
                assert not re.search(r"\[(SYS|INST|ANS|ROLE:|/)|</?s>", s["text"])
    assert C.digests(C.format_conversations(df.limit(0))).count() == 0


# Packing


def test_packing_places_every_piece_once(docs, empty):
    from quarry.llm.packing import pack_documents

    rows = pack_documents(docs, size=64).collect()
    want = {i: library_ids_cached("byte_bpe_50k.json", t, 2) for i, t in TEXTS}
    bins, ids = {}, {}
    for r in rows:
        assert r["length"] == len(r["ids"]) // 4 <= 64 and (r["piece"] == 0 or r["length"] == 64)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        ids.setdefault(r["doc_id"], []).append((r["piece"], r["start"], bytes(r["ids"])))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    assert sum(r["piece"] == 0 for r in rows) == len(TEXTS)
    for i, parts in ids.items():
        seen = sorted(set(parts))
        assert np.frombuffer(b"".join(p[2] for p in seen), "<u4").tolist() == want[i]
    assert pack_documents(empty).count() == 0


def test_plan_is_near_the_fewest_bins():
    """Against the fewest bins by trying all ways, on small sets of pieces."""
    from functools import lru_cache

    from quarry.llm.packing import plan

    @lru_cache(maxsize=None)
    def fewest(left: tuple, gaps: tuple) -> int:
        if not left:
            return len(gaps)
        n, rest = left[0], left[1:]
        ways = {tuple(sorted([*gaps[:i], gaps[i] - n, *gaps[i + 1 :]])) for i in range(len(gaps)) if gaps[i] >= n}
        return min(fewest(rest, g) for g in [*ways, tuple(sorted([*gaps, 12 - n]))])

    rng = np.random.default_rng(2)
    over = 0
    for _ in range(60):
        pieces = sorted(rng.integers(1, 13, rng.integers(1, 9)).tolist(), reverse=True)
        counts = [pieces.count(n) for n in range(13)]
        got, least = sum(times for _, times in plan(counts, 12)), fewest(tuple(pieces), ())
        assert least <= got <= least + 1
        over += got - least
    assert over <= 3


def test_plan_uses_all_and_packs_tightly():
    from quarry.llm.packing import plan

    rng = np.random.default_rng(6)
    counts = [0, *rng.integers(0, 50, 1024).tolist()]
    used = Counter()
    bins = 0
    for pattern, times in plan(counts):
        assert sum(pattern) <= 1024 and times > 0
        bins += times
        for n in pattern:
            used[n] += times
    assert all(used[n] == c for n, c in enumerate(counts))
    assert bins <= 1.02 * sum(n * c for n, c in enumerate(counts)) / 1024 + 1
    assert plan([0, 0, 3, 2, 0], 4) == [([3], 2), ([2, 2], 1), ([2], 1)]
    # 9 takes 4 greedily; two of 3 fit its gap of 11 more tightly than the 4
    assert plan([0, 0, 0, 2, 1, 0, 0, 0, 0, 1, *[0] * 6], 15)[0] == ([9, 3, 3], 1)
