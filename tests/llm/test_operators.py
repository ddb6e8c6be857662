"""Small fixtures with nulls, empty texts, ties, repeated rows and extra columns, against plain versions."""

import collections
import hashlib
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from circlet.llm import components, decontaminate, embedding_dedup, language_id, line_dedup, lm_score, minhash_dedup, source_mix, suffix_dedup, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, target string, rule string"


def _docs(spark, texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    sources = [f"s{i % 3}" for i in range(len(texts))] if sources is None else sources
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "x", "y") for i, t, s in zip(ids, texts, sources)], DOCS)


def _words(rng, n):
    return [rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randrange(40)) for _ in range(n)]


ODD = [None, "", " \n\t ", "one", "!!!", "é", "x" * 5000]


def test_components(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), *[(20 + i, 21 + i) for i in range(30)]], "a long, b long")
    got = {r.node: r.component for r in components.components(pairs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, **{20 + i: 20 for i in range(31)}}
    assert components.components(pairs.limit(0)).count() == 0


def test_source_mix(spark):
    rng = random.Random(1)
    texts = [" ".join(_words(rng, rng.randrange(1, 200))) for _ in range(200)] + ODD
    docs = _docs(spark, texts, sources=[rng.choice(["a", "a", "a", "b", None]) for _ in texts])
    rows = source_mix.mix(docs).collect()
    assert len(rows) == len(texts) and sorted(map(tuple, rows), key=str) == sorted(map(tuple, source_mix.mix(docs).collect()), key=str)
    taken, target = collections.Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    total = sum(r["size"] for r in rows)
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 * total
    assert all(r.position is None or 0 <= r.position <= 1 for r in rows)
    assert source_mix.mix(docs.limit(0)).count() == 0
    early = source_mix.mix(docs, schedule=[(0.0, (1.0, 0.0, 1.0)), (0.5, (1.0, 1.0, 1.0)), (1.0, (0.0, 1.0, 1.0))]).where("position is not null").groupBy("source").avg("position").collect()
    place = {r[0]: r[1] for r in early}
    assert place["a"] < place["b"]


def test_source_mix_takings(spark, tmp_path):
    """Every taken word has a position; the schedule varies with time, its integrals are the weights."""
    from circlet.llm import queries

    rng = random.Random(2)
    texts = [" ".join(_words(rng, rng.randrange(1, 60))) for _ in range(900)] + ODD
    _docs(spark, texts, sources=["a" if i % 9 == 0 else "b" if i % 2 else "c" for i in range(len(texts))]).write.parquet(str(tmp_path / "documents.parquet"))
    mixed = {r.doc_id: r for r in queries.source_mix.mix(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()}
    rows = queries.QUERIES["op1_training_order"](spark, str(tmp_path)).collect()
    words, n, early = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows:
        words[r.doc_id] += r.words
        n[r.doc_id] += 1
        early[r.source, r.position < 0.5] += r.words
    assert all((words[i], n[i], len(r.positions)) == (r.taken, r.n_epochs, r.n_epochs) for i, r in mixed.items())
    assert max(n.values()) == 2 and all(r.positions == sorted(r.positions) for r in mixed.values())
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    # lead: 0, 1/2 and 1 less their weighted mean, 1/4; the first half of the tilt is -0.3 in all
    for source, lead in (("a", -0.25), ("b", 0.25), ("c", 0.75)):
        assert abs(early[source, True] / (early[source, True] + early[source, False]) - (0.5 - 0.3 * lead)) < 0.02


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://WWW.Example.com/en/72?q", "https://example.com/en/8#x", "ftp://a.example.net/de/81", "x://b.net/de/", "http://net", "http://org/es/a/b", "http://myorg/es/", "http://com/en"]
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    rows = url_filter.filter_urls(spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, rule string"), rules).orderBy("page_id").collect()
    for url, r in zip(urls, rows):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_url_filter_random_rules(spark):
    """Against all rules one by one: the longest wins, then the longer host, then block; many rests at one node, long and odd urls, repeated rows, an empty table."""
    rng = random.Random(20)
    labels, parts = ["a", "bc", "com", "x-y"], ["", "e", "en", "en/", "en/l", "en/long/path", "q/é"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 4)))
    rules = [(rng.choice(["block", "allow"]), host(), rng.choice(["", "/"]) + rng.choice(parts)) for _ in range(120)]
    rules += [("block", "com", f"/n{i}") for i in range(500)] + [("block", "com", "/en/long/path"), ("allow", "a.com", "/e")]
    urls = [f"http://{host().upper()}/{rng.choice(parts)}{rng.choice(['', 'x', '/y', '?en', '#z'])}" for _ in range(400)] + ["http://a.com/en/long/path/1", "http://com/n499/", "http://com/" + "z" * 200_000, "a://b://c/en", "://", "http://a.com\n/en", None, None]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, row string")
    out = url_filter.filter_urls(pages, rules)
    assert out.columns == ["page_id", "url", "row", "host", "path", "rule", "verdict"]
    for r in out.collect():
        url = urls[r.page_id]
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        h, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(x + p), len(x), v == "block", x + p, v) for v, x, p in rules if (h == x or h.endswith("." + x)) and path.startswith(p)]
        assert (r.host, r.path, r.rule, r.verdict) == (h, path, *(max(fits)[3:] if fits else (None, "allow"))), url
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_warc_files_and_ranges(spark, tmp_path):
    """Files that roll over, records that are far apart, long payloads; decisions by shuffle; only the wanted records are read."""
    rng = random.Random(21)
    texts = ["".join(rng.choice("abcdé") for _ in range(rng.choice([5, 300, 40_000]))) for _ in range(60)]
    texts += [texts[i] for i in range(0, 60, 3)] + ["x" * 3_000_000, None]
    pages = spark.createDataFrame([(i, f"u{i}", t, "x", "y") for i, t in enumerate(texts)], "page_id long, url string, html string, digest string, size string").repartition(2)
    for limit in (10**6, 0):
        folder = f"file://{tmp_path}/{limit}"
        index = warc.write(pages, folder, file_bytes=20_000, broadcast_digests=limit)
        assert index.select("file").distinct().count() > 4
        rows = {r.page_id: r for r in warc.read(index.where("page_id % 4 <> 1"), folder).collect()}
        assert set(rows) == {i for i in range(len(texts)) if i % 4 != 1}
        first = {t: min(i for i, x in enumerate(texts) if x == t) for t in texts}
        for i, r in rows.items():
            data = (texts[i] or "").encode()
            again = len(data) >= 100 and first[texts[i]] != i
            assert (r.payload_bytes, r.payload_digest, r.refers_to) == (len(data), hashlib.sha256(data).hexdigest(), first[texts[i]] if again else None)
            assert bytes(r.body) == (b"" if again else data) and r.url == f"u{i}"


def test_warc(spark):
    long = "<p>é" * 40
    pages = spark.createDataFrame([(5, "http://a", long), (2, None, long), (9, "http://b\r\nX: 1", long), (7, "u", "short"), (8, "u", "short"), (1, "u", None), (4, "u", "ab\r\n\r\n" * 30), (None, "u", long)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(rows) == 8
    for p in pages.collect():
        data = (p.html or "").encode()
        r = rows[p.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 2) if p.html == long and p.page_id != 2 else ("response", None))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_lm_score(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["red", "green"]) for _ in range(20)) for _ in range(20)] + [" ".join(rng.choice(["one", "two", "red"]) for _ in range(20)) for _ in range(20)] + ODD
    docs = _docs(spark, texts)
    target = docs.where("doc_id < 20").select("doc_id")
    model = lm_score.train(docs, target)
    known = lm_score._Numbers()
    count = collections.Counter(n for t in texts for n in lm_score.word_numbers(t, known)[1:])
    assert all(model["word_background"][n] == c for n, c in count.items()) and model["word_background"].sum() == sum(count.values())
    rows = lm_score.score(docs, model).orderBy("doc_id").collect()
    assert max(r.score for r in rows[:20]) < min(r.score for r in rows[20:40])
    assert [r.score is None for r in rows[40:]] == [not (t or "").split() for t in ODD]
    assert all(r.score is None for r in lm_score.score(docs.where("doc_id = 40"), lm_score.train(docs.limit(0), target.limit(0))).collect())


def test_lm_score_counts_every_bigram(spark):
    """Against a plain model, with more words and bigrams than any table of a fixed size held: 120,000 and more."""
    import math

    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" if k % 3 else "the" for k in range(3000)) for _ in range(70)] + ["the the the The", "the the the The", "w1 unseen"]
    docs = _docs(spark, texts[:-1])
    word, before, pair = ([collections.Counter(), collections.Counter()] for _ in range(3))
    for i, t in enumerate(texts[:-1]):
        w = t.lower().split()
        for side in (0, 1) if i < 20 else (0,):
            word[side].update(w)
            before[side].update(["", *w[:-1]])
            pair[side].update(zip(["", *w], w))
    assert len(word[0]) > 1 << 16
    size = [sum(c.values()) for c in word]

    def mean(text, side):
        w, total = text.lower().split(), 0.0
        for a, b in zip(["", *w], w):
            alone = (word[side][b] + 0.1) / (size[side] + 0.1 * (len(word[0]) + 1))
            total -= math.log(0.7 * pair[side][a, b] / before[side][a] + 0.3 * alone if before[side][a] else alone)
        return total / len(w)

    model = lm_score.train(docs, docs.where("doc_id < 20").select("doc_id"))
    rows = lm_score.score(_docs(spark, texts), model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_words == len(texts[r.doc_id].split())
        assert abs(r.target_loss - mean(texts[r.doc_id], 1)) < 1e-9 and abs(r.background_loss - mean(texts[r.doc_id], 0)) < 1e-9


def test_lm_score_leaves_itself_out(spark):
    """Every loss against a plain model of the other rows; repeated rows, shared and null ids, ties, several blocks, clashing columns."""
    import math

    rng = random.Random(50)
    words = ["red", "green", "Blue", "é", "x" * 300]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(60)] + ["alone here", "red red", "red red", *ODD]
    ids = [*range(len(texts) - 2), 3, None]
    docs = _docs(spark, texts, ids=ids).withColumns({"own": F.lit("z"), "block": F.lit(1), "id": F.lit(2), "n": F.lit(3)})
    target = spark.createDataFrame([(i,) for i in [*range(0, 60, 3), 61, 61, None]], "doc_id long")
    own = [i in {*range(0, 60, 3), 61} for i in ids]

    def mean(k, side):
        word, before, pair = (collections.Counter() for _ in range(3))
        vocabulary = set()
        for i, t in enumerate(texts):
            w = (t or "").encode().lower().split()
            vocabulary.update(w)
            if i != k and (own[i] or not side):
                word.update(w)
                before.update([b"", *w[:-1]] if w else [])
                pair.update(zip([b"", *w], w))
        w, total = texts[k].encode().lower().split(), 0.0
        for a, b in zip([b"", *w], w):
            alone = (word[b] + 0.1) / (sum(word.values()) + 0.1 * (len(vocabulary) + 1))
            total -= math.log(0.7 * pair[a, b] / before[a] + 0.3 * alone if before[a] else alone)
        return total / len(w)

    rows = lm_score.score(docs, lm_score.train(docs, target, block_words=200)).collect()
    want = [(ids[k], len(t.split()), round(mean(k, 1), 9), round(mean(k, 0), 9)) if (t or "").split() else (ids[k], 0, None, None) for k, t in enumerate(texts)]
    got = [(r.doc_id, r.n_words, *(x if x is None else round(x, 9) for x in (r.target_loss, r.background_loss))) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(r.score is None if r.n_words == 0 else abs(r.score - (r.target_loss - r.background_loss)) < 1e-12 for r in rows)
    assert lm_score.score(docs.limit(0), lm_score.train(docs, target)).count() == 0


def _near(texts, n, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(texts)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_minhash(spark):
    rng = random.Random(6)
    base, other = _words(rng, 200), _words(rng, 120)
    texts = [" ".join(base)]
    for k in range(90):  # a large group: long lists
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"edit{k}"
        texts.append(" ".join(w))
    texts += [" ".join(other[:80] + _words(rng, 60)) for _ in range(60)]  # share a passage only
    texts += ODD + [" ".join(base).upper(), "one", "a b c", "A b  c"]
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(_docs(spark, texts), 4, 80).collect()}
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == _near(texts, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_minhash_odd_tables(spark):
    assert minhash_dedup.near_duplicates(_docs(spark, ["a"]).limit(0)).count() == 0
    rows = minhash_dedup.near_duplicates(_docs(spark, ["a b c"] * 3 + [None], ids=[7, 7, None, None])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in rows) == [("7", "7", True), ("7", "7", True), ("None", "7", False), ("None", "None", True)]


def test_decontaminate(spark):
    rng = random.Random(8)
    items = [" ".join(_words(rng, 30)), " ".join(_words(rng, 5)), "", None, " ".join(_words(rng, 13))]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    clean = lambda n: " ".join(_words(rng, n))
    texts = [clean(20) + " " + items[0].upper().replace(" ", ", ") + " " + clean(30), items[1] + "; " + items[1], clean(900) + " " + " ".join(items[0].split()[3:17]), items[4], clean(50), *ODD]
    rows = decontaminate.judge(_docs(spark, texts + [items[4]], ids=[*range(len(texts)), 3]), bench).collect()
    assert len(rows) == len(texts) + 1
    at = {r.doc_id: r for r in rows}
    assert (at[0].n_hit, at[0].n_items, at[0].contaminated) == (30, 1, True)
    assert (at[1].n_words, at[1].n_hit, at[1].contaminated) == (10, 10, True)
    assert (at[2].n_hit, at[2].contaminated) == (14, False)
    assert at[3].items_sha256 == hashlib.sha256(b"4").hexdigest() and at[4].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert at[5].n_words == 0 and sum(r.doc_id == 3 for r in rows) == 2
    assert {r.doc_id for r in decontaminate.decontaminate(_docs(spark, texts), bench).collect()} == set(range(len(texts))) - {0, 1, 3}
    assert decontaminate.judge(_docs(spark, texts), bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontaminate_plainly(spark):
    """Windows of several lengths by broadcast and by shuffle, and what is left without them, against a plain version; odd items, repeated rows."""
    import re

    rng = random.Random(80)
    word = lambda: rng.choice("abc")
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((3, 3, 4, 5, 13, 14, 20))] + [(2, "B, a; c!"), (None, "c c c c c"), (7, None), (8, ""), (9, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("items", F.lit("x"))
    texts = [" ".join(word() if k % 17 else "É" for k in range(rng.randrange(60))) for _ in range(40)] + [items[6][1] + " z", items[4][1].upper(), *ODD]
    ids = [*range(len(texts) - 2), 4, None]
    docs = _docs(spark, texts, ids=ids).unionByName(_docs(spark, texts[:1])).withColumns({c: F.lit("x") for c in ("start", "length", "words", "hashes", "_key")})
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})))
    held = {}
    for i, t in items:
        w = cut(t)
        for s in range(max(len(w) - 12, 1) if w else 0):
            held.setdefault(tuple(w[s : s + 13]), set()).add(i)
    want = []
    for i, t in [*zip(ids, texts), (0, texts[0])]:
        w = cut(t)
        hit, found = set(), set()
        for n in {len(g) for g in held}:
            for s in range(len(w) - n + 1):
                if (g := tuple(w[s : s + n])) in held:
                    hit |= set(range(s, s + n))
                    found |= held[g] - {None}
        names = ",".join(sorted(map(str, found)))
        want.append(((i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)), (i, tuple(x for k, x in enumerate(w) if k not in hit))))
    for limit in (10**6, 0):
        got = decontaminate.judge(docs, bench, broadcast_windows=limit).drop("key").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(str(x) for x, _ in want), limit
    left = [(r.doc_id, tuple(r.kept_words)) for r in decontaminate.remove_spans(docs, bench).collect()]
    assert sorted(map(str, left)) == sorted(str(x) for _, x in want)


def test_suffix_dedup(spark):
    rng = random.Random(9)
    shared = "".join(rng.choice("abcdé ") for _ in range(400))
    part = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    texts = [part(150) + shared + part(50), shared, part(30) + shared[50:170] + part(30), shared[:99], "ab" * 300, "ab" * 80, part(120) * 3, None, "", shared + shared[100:300]]
    got = {r.doc_id: r for r in suffix_dedup.strip(_docs(spark, texts)).collect()}
    seen = set()
    for i, t in enumerate(texts):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = b"\x01" * 100
            seen.add(data[s : s + 100])
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(c for c, g in zip(data, gone) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept) == (len(data), sum(gone), spans, kept), i
    assert suffix_dedup.strip(_docs(spark, ["a"]).limit(0)).count() == 0


def test_suffix_dedup_by_merged_transforms(spark):
    """Whole documents against the merge of their shards' Burrows-Wheeler transforms; and that against plain strings."""
    from circlet.llm import bwt_merge

    rng = random.Random(91)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(60))).encode() for _ in range(40)]
    seen, want = set(), []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - 9):
            gone[s : s + 10] |= t[s : s + 10] in seen
            seen.add(t[s : s + 10])
        want.append(gone.tolist())
    for shard in (64, 10**6):
        assert [g.tolist() for g in bwt_merge.removed(texts, 10, shard)[0]] == want
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in docs.collect())
    gone, rounds = bwt_merge.removed([t for _, t in rows], suffix_dedup.LENGTH, 1 << 17)
    got = {r.doc_id: (r.n_removed, r.kept) for r in suffix_dedup.strip(docs).collect()}
    assert rounds == 100 and sum(int(g.sum()) for g in gone) > 10_000
    assert got == {i: (int(g.sum()), np.frombuffer(t, np.uint8)[~g].tobytes()) for (i, t), g in zip(rows, gone)}


def test_suffix_dedup_odd_rows(spark):
    """Repeated rows are one document; null and shared ids: nulls first, then by id, then by a hash of the text."""
    rng = random.Random(90)
    part = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    one, two, three = part(400), part(250), part(300)
    rows = [(1, one), (1, one), (5, two + part(40)), (None, two), (None, two), (2, three), (2, part(20) + three), (7, one[100:350]), (7, one[100:350])]
    docs = _docs(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    keys = {r.text: r.k for r in docs.select("text", F.xxhash64("text").alias("k")).collect()}
    seen, want = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, keys[r[1]])):
        gone = [False] * len(t)
        for s in range(len(t) - 99):
            if t[s : s + 100] in seen:
                gone[s : s + 100] = [True] * 100
            seen.add(t[s : s + 100])
        want[i, t] = "".join(c for c, g in zip(t, gone) if not g)
    got = collections.Counter((r.doc_id, r.n_bytes, r.kept.decode()) for r in suffix_dedup.strip(docs).collect())
    assert got == collections.Counter((i, len(t), want[i, t]) for i, t in rows)


def test_line_dedup(spark):
    rng = random.Random(10)
    passage = [" ".join(_words(rng, 8)) for _ in range(30)]
    own = lambda n: [" ".join(_words(rng, 8)) for _ in range(n)]
    texts = ["\n".join(own(5) + passage + own(5)), "\n".join(own(9) + passage), "\n".join(own(4)), "\n\n\n", *ODD]
    docs = _docs(spark, texts)
    rows = {r.doc_id: r for r in line_dedup.dedup(docs).collect()}
    assert rows[0].text == texts[0] and rows[2].text == texts[2] and [rows[i].text for i in range(3, 11)] == texts[3:]
    left = rows[1].text.split("\n")
    assert left[:9] == texts[1].split("\n")[:9] and len(left) < 39 - 10
    assert line_dedup.report(docs.limit(0)).count() == 0


def _line_dedup(rows):
    """What is left of each different (id, text), line by line."""
    seen, out = set(), {}
    for i, text in rows:
        lines = text.split("\n")
        late = {k for k in range(len(lines) - 1) if (lines[k], lines[k + 1]) in seen or (lines[k], lines[k + 1]) in set(zip(lines[:k], lines[1:]))}
        seen |= set(zip(lines, lines[1:]))
        covered = sorted(late | {k + 1 for k in late})
        gone, run = set(), []
        for k in [*covered, None]:
            if run and (k is None or k > run[-1] + 1):
                gone |= set(run) if sum(bool(lines[x].strip(" \t\n\v\f\r")) for x in run) >= 2 else set()
                run = []
            run.append(k)
        out[i, text] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup_short_passages(spark):
    """Passages of 2 to 5 lines in unlike surroundings go wholly from all places but the first; so do long ones in hot groups."""
    rng = random.Random(100)
    line = lambda: " ".join(_words(rng, 12))
    passages = [[line() for _ in range(n)] for n in (2, 2, 3, 4, 5, 12)]
    rows = []
    for i in range(240):
        lines = [line() for _ in range(rng.randrange(6))] + (rng.choice(passages) if i % 5 else passages[0]) + [line() for _ in range(rng.randrange(6))]
        rows.append((i, "\n".join(lines)))
    rows += [(240, "a\na\na\na"), (241, "\t\n\n \n\n"), (242, "\t\n\n \n\n"), (243, "\n" + line()), (244, "x" * 100_000 + "\ny\nx"), (245, "y\nx\nz"), (246, "one line only"), (247, "one line only")]
    docs = _docs(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    want = _line_dedup(rows)
    got = {r.doc_id: r.text for r in line_dedup.dedup(docs).collect()}
    assert got == {i: want[i, t] for i, t in rows}
    runs = [{(r._id, r._key): [tuple(x) for x in r.runs] for r in line_dedup.repeated(docs, broadcast_hashes=n).collect()} for n in (10**6, 0)]
    assert runs[0] == runs[1] and len(runs[0]) > 200
    kept = collections.Counter(x for t in got.values() for x in t.split("\n"))
    assert all(kept[x] == 1 for p in passages for x in p) and got[245] == "z" and got[242] == "\t\n\n \n\n"


def test_line_dedup_odd_rows(spark):
    """Nulls first, then ids; rows that are equal in id and text are one document; clashing columns."""
    text = "first line\nsecond line\nthird"
    rows = [(None, text), (1, text), (1, text), (2, "own\n" + text), (None, None), (3, "")]
    docs = _docs(spark, [t for _, t in rows], ids=[i for i, _ in rows]).withColumns({c: F.lit(c) for c in ("_id", "_key", "runs", "row", "lines", "start")})
    out = line_dedup.dedup(docs)
    assert out.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text, r.runs) for r in out.collect()) == collections.Counter([(None, text, "runs"), (1, "", "runs"), (1, "", "runs"), (2, "own", "runs"), (None, None, "runs"), (3, "", "runs")])
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(11)
    base = rng.standard_normal(32)
    vectors = [(base + 0.1 * rng.standard_normal(32)).tolist() for _ in range(60)] + [rng.standard_normal(32).tolist() for _ in range(60)]
    vectors += [None, [], [0.0] * 32, [float("nan")] * 32, [None] + [1.0] * 31, [float("inf")] * 32, vectors[0], [v * 7 for v in vectors[61]]]
    table = spark.createDataFrame([(i, v, 0, "q") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int, keys string")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table).collect()}
    fine = [i for i in range(len(vectors)) if not 120 <= i < 126]
    x = np.array([vectors[i] for i in fine])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.9).sum(axis=1) - 1
    assert {i: got[i].n_links for i in fine} == dict(zip(fine, near))
    assert all(got[i].n_links == 0 and got[i].kept for i in range(120, 126)) and got[126].component_id == 0 and got[127].component_id == 61
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_embeddings_odd_rows(spark):
    """Pairs planted at cosines of 0.9 to 0.92 are found (0.97 of those at 0.9 by design); huge and tiny components, unlike lengths, null, shared and repeated ids; float and double."""
    rng = np.random.default_rng(12)

    def pair(cosine):
        x, y = (v / np.linalg.norm(v) for v in rng.standard_normal((2, 48)))
        y -= (x @ y) * x
        y /= np.linalg.norm(y)
        return x.tolist(), (cosine * x + math.sqrt(1 - cosine * cosine) * y).tolist()

    import math

    planted = [v for _ in range(400) for v in pair(rng.uniform(0.9005, 0.92))]
    odd = [[1e200, 2e200, 3e200], [1e200, 2e200, 3.0001e200], [1.0, 2.0, 3.0], [1e-300, 2e-300, 3e-300], [1.0, 2.0, 3.0, 0.0], [-1.0, -2.0, -3.0]]
    rows = list(enumerate(planted + odd)) + [(None, odd[2]), (2000, odd[2]), (2000, odd[2]), (7, odd[5])]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("rep", "weight", "label", "t", "key")})).collect()
    got = {r.vec_id: r for r in out}
    assert len(out) == len(rows) and sum(got[i].n_links > 0 for i in range(0, 800, 2) if i not in (6, 7)) >= 0.95 * 399
    assert [(got[i].n_links, got[i].component_id) for i in (800, 801, 802, 803, 804)] == [(4, 800)] * 4 + [(0, 804)]
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, True) and got[2000].n_links == 4
    assert {(r.n_links, r.component_id) for r in out if r.vec_id in (805, 7) and r.n_links == 1 and r.component_id == 7} and not got[805].kept
    single = spark.createDataFrame(list(enumerate(planted)), "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(single).where("n_links > 0").count() >= 0.95 * 800


def test_language_id(spark):
    docs = spark.createDataFrame([(i, "the cat and the dog are here now" if i % 2 else "der hund und die katze sind jetzt hier", "en" if i % 2 else "de") for i in range(40)] + [(40 + i, t, "en") for i, t in enumerate(ODD)], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert all(rows[i].lang_pred == ("en" if i % 2 else "de") for i in range(40))
    assert [rows[40 + i].lang_pred == "und" for i in range(len(ODD))] == [not language_id.has_letter(t) for t in ODD]
    assert all(0 <= r.score <= 1 for r in rows.values()) and any(r.held_out for r in rows.values())
    assert language_id.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_pipeline(spark, tmp_path):
    """Each stage on all that its predecessor kept: plain versions for near_dedup, SQL for the others but language_id."""
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(10**6 + i, t, "en", None, 0) for i, t in enumerate([*ODD, "!!! 12", None])]
    docs = real.unionByName(spark.createDataFrame(odd, real.schema)).unionByName(real.limit(3))
    sql = duckdb.connect()
    sql.execute(f"create view benchmark as from '{sf_dir}/benchmark.parquet'")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        docs.coalesce(1).write.parquet(f"{path}-in")
        docs = spark.read.parquet(f"{path}-in")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        got, before = spark.read.parquet(path), docs.collect()
        rows = got.collect()
        sql.execute(f"create view {name} as from '{path}-in/*.parquet'")
        ids = collections.Counter(r.doc_id for r in rows)
        assert got.columns == docs.columns + (["epoch", "words", "position"] if name == "mix" else []), name
        if name == "language_id":
            gone = {r.doc_id for r in before} - set(ids)
            assert {r.doc_id for r in before if not language_id.has_letter(r.text)} <= gone
            assert not [r for r in before if r.doc_id in gone and len((r.text or "").split()) >= 50]
        elif name == "line_dedup":
            want = sql.execute("select doc_id, kept_md5, n_removed from (" + line_dedup.ORACLE.format(documents=name) + ")").fetchall()
            blank = {hashlib.md5(b"\n" * k).hexdigest() for k in range(9)}
            gone = {i for i, md5, n in want if n and md5 in blank}  # of these nothing is left
            assert gone and sorted((i, md5) for i, md5, _ in want if i not in gone) == sorted((r.doc_id, hashlib.md5(r.text.encode()).hexdigest()) for r in rows)
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "near_dedup":
            first = sorted({r.doc_id: r.text for r in before}.items())
            kept = {first[i][0] for i, (_, component) in enumerate(_near([t for _, t in first], 5, 80)) if component == i}
            assert ids == collections.Counter(r.doc_id for r in before if r.doc_id in kept)
        elif name == "decontaminate":
            clean = sql.execute("select doc_id from (" + decontaminate.ORACLE.format(documents=name) + ") where not contaminated").fetchall()
            assert ids == collections.Counter(i for (i,) in clean)
        else:
            # a row for each taking, with the document: its words and the first and last position by SQL
            want = sql.execute("select doc_id, sum(taken), sum(n_epochs), min(first_position), max(last_position) from (" + source_mix.ORACLE.format(documents=name) + ") where taken > 0 group by 1").fetchall()
            words, at = collections.Counter(), collections.defaultdict(list)
            for r in rows:
                words[r.doc_id] += r.words
                at[r.doc_id].append(round(r.position, 9))
            assert sorted(want) == sorted((i, n, ids[i], min(at[i]), max(at[i])) for i, n in words.items())
            texts = {(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in before}
            assert {(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows} == {t for t in texts if t[0] in words}
            order = [r.position for r in out.collect()]
            assert order == sorted(order) and max(ids.values()) > 1
        docs = got
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_odd_tables(spark, tmp_path):
    """run() over documents with columns that clash with inner names and null ids, and over an empty table; noise and other scripts go."""
    import corpus_pipeline

    clash = ["_file", "_row", "row", "doc", "words", "position", "epoch", "size", "target", "_spans", "_lines", "_judged", "lang_fit", "_gone", "_bad_id", "hashes", "key", "rep", "kept"]
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 60").limit(60)
    rng = random.Random(70)
    noise = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(300)), " ".join("".join(rng.choice("qxzjkw") for _ in range(7)) for _ in range(60))]
    more = [(10**6 + i, t, None, "src1", 1) for i, t in enumerate(noise)] + [(None, real.first().text + " and one more", "en", "src1", 1), (None, None, None, None, None)]
    docs = real.unionByName(spark.createDataFrame(more, real.schema)).withColumns({c: F.lit("z") for c in clash})
    for label, table in (("some", docs), ("none", docs.limit(0))):
        folder = tmp_path / label
        table.write.parquet(str(folder / "documents.parquet"))
        spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(folder / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(folder))
        assert out.columns == [c for c in docs.columns if c not in ("words", "position", "epoch")] + ["epoch", "words", "position"]
        rows = out.collect()
        if label == "none":
            assert rows == []
            continue
        assert {10**6, 10**6 + 1}.isdisjoint({r.doc_id for r in rows}) and len({r.doc_id for r in rows} - {None}) > 20
        assert all(r["_file"] == r["size"] == r["kept"] == "z" and r.text and r.words > 0 for r in rows)
        assert [r.position for r in rows] == sorted(r.position for r in rows)
        kept = corpus_pipeline.STAGES[0][1](spark, table, str(folder)).collect()
        assert {r.doc_id for r in table.collect()} - {r.doc_id for r in kept} == {10**6, 10**6 + 1}


def test_language_id_letters():
    """Letters are those of the Unicode categories L; ties go to the first name; a text of blocks is scored as a whole."""
    assert [language_id.has_letter(t) for t in ("½ ² 12", "٣", "é", "語", "_", "ª", "x" * 10)] == [False, False, True, True, False, True, True]
    matrix = np.zeros((language_id.BINS + 1, 2), np.float32)
    best, score, fit = language_id.score_texts(["abc", "1"], ["a", "b"], matrix, np.zeros(2))
    assert best == ["a", "und"] and list(score) == [0.5, 0.0] and np.isnan(fit[1])
