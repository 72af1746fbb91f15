"""The operators on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowsense.llm import chat_format, fingerprints, html_extract, jaccard_join, mixing, packing, queries, secret_scan, topk_search, toxicity, warc_archive

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(30000))
TOKENIZER = str(public_tokenizers.path("word_bpe_49k.json"))


def odd_docs(spark):
    texts = [None, "", "   ", "one", "a b c d e f g", "a b c d e f g", LONG, "password = hunter2hunter2 <|endoftext|> Ünïcode ½ it's", None]
    rows = [(None if i == 8 else i, t, "en", None if i % 2 else "s", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4]], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    other = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, other))


def test_html(spark):
    page = """<!doctype html><html><body class="page"><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies</div>
      <main><article><h1>A &amp; B</h1><p>First  <b>bold</b><p>Second<br>line<script>var x = "</p>";</script><div class=ad>Buy</div><ul><li>item</ul>
      <section id="comments"><p>Reader says</p></section></article></main><aside>Side</aside><form><input>Send</form><footer>&copy; X</footer>"""
    expected = "A & B\nFirst bold\nSecond line\nitem"
    rows = [(1, "http://a/1", page), (2, "http://a/2", page.replace("First", "Other")), (3, None, None), (4, "x", ""), (5, "http://b", "<" * 2000 + "p>x"), (1, "http://a/1", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("rules", F.lit(1))
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract(df).collect()))
    assert got[:3] == [(1, expected, len(expected))] * 2 + [(2, expected.replace("First", "Other"), len(expected))]
    assert got[3:5] == [(3, "", 0), (4, "", 0)]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_wrapper_takes_optional_and_repeated_parts():
    a = html_extract.wrapper_of("<div><p>x</p><p>y</p></div>")
    b = html_extract.wrapper_of("<div><h2>t</h2><p>z</p></div>")
    both = html_extract.merge(a, b, True)
    assert [(i[0], i[1], i[2]) for i in both[6][0][6]] == [("h2", 0, 0), ("p", 1, 1)]


def test_fingerprints(spark):
    got = fingerprints.compare_edited(odd_docs(spark)).collect()
    assert len(got) == 10 and all(0 <= r["near_next"] <= 1 for r in got)
    equal = {r["fingerprint"] for r in got if r["doc_id"] in (4, 5)}
    assert len(equal) == 1
    x = np.random.default_rng(1).integers(97, 123, 400).astype("<u4")
    at, h = fingerprints.winnow(x, 5, 7)
    grams = fingerprints.gram_hashes(x, 5)
    brute = sorted({max(range(i, i + 7), key=lambda j: (-int(grams[j]), j)) for i in range(len(grams) - 6)})
    assert at.tolist() == brute and h.tolist() == [int(grams[j]) for j in brute]
    assert fingerprints.compare_edited(empty(spark)).count() == 0


def test_secrets(spark):
    got = {r["path"]: r["findings"] for r in secret_scan.secret_scan(odd_docs(spark)).collect()}
    assert [(f["rule"], f["start"], f["end"]) for f in got[7]] == [("assign", 0, 25)] and got[0] == []
    assert secret_scan.secret_scan(empty(spark)).count() == 0


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    secret_scan.secret_scan(odd_docs(spark), ledger).count()
    before = spark.read.parquet(ledger).count()
    secret_scan.secret_scan(odd_docs(spark), ledger).count()
    assert spark.read.parquet(ledger).count() == before


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "u", "same"), (2, None, "same"), (3, "u\r\nX: y", "é"), (None, "n", "only"), (5, "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc_archive.write_archives(pages, f"file://{tmp_path}/w")
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"], bytes(r["payload"])) for r in warc_archive.read_records(index, f"file://{tmp_path}/w").collect()}
    assert got == {1: ("revisit", 2, 4, b""), 2: ("response", None, 4, b"same"), 3: ("response", None, 2, "é".encode()), None: ("response", None, 4, b"only"), 5: ("response", None, 0, b"")}


def test_topk_ties_and_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (50, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk_search.topk(df, F.col("vec_id") % 50 == 0, 2).collect())
    assert got == [(0, 1, 1, 65536), (0, 2, 2, 65536), (50, 1, 0, 32768), (50, 2, 1, 32768)]
    assert topk_search.topk(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_of_large_and_repeated_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * 10.0 ** rng.integers(0, 7)).tolist()) for i in range(300)] + [(3, [1e6] * 6), (3, [1e6] * 6), (None, [2e6] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash")).withColumn("norm", F.lit(1))
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    want = set()
    for q, a in [x for x in whole if x[0] is not None and x[0] % 50 == 0]:
        found = sorted((-sum(x * y for x, y in zip(a, b)), i is None, i or 0) for i, b in whole if i != q)[:4]
        want |= {(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(found)}
    got = {tuple(r) for r in topk_search.topk(df, F.col("vec_id") % 50 == 0, 4, block=16, groups=20).collect()}
    assert got == want


def test_mixing_conserves_quotas(spark):
    docs = odd_docs(spark).withColumn("size", F.lit("clash"))
    mixed = mixing.mix(docs, block_words=64, shard_blocks=16)
    rows = mixed.select("source", "target", "size", F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + x["n_words"]).alias("taken")).collect()
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < 1
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix(empty(spark)).count() == 0


def test_mixing_leaves_texts_where_they_are(spark, monkeypatch):
    """Only rows that a hash can't tell apart are written with their texts; what is mixed is the same."""
    tables, written = [], mixing.written
    monkeypatch.setattr(mixing, "written", lambda df, label: tables.append(df.columns) or written(df, label))
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(i * 7 % 50)), "en", "ab"[i % 2], 0) for i in range(60)]
    mixed = lambda of: mixing.mixed_texts(spark.createDataFrame(of, DOCS), block_words=16, shard_blocks=8).collect()
    got = mixed(rows)
    assert tables and not any({"doc", "text"} & set(c) for c in tables)
    docs = mixing.sized(spark.createDataFrame(rows, DOCS))
    plain = mixing.drawn(docs, block_words=16, shard_blocks=8).select("doc.doc_id", F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + x["n_words"]).alias("n")).filter("n > 0").collect()
    taken: dict = {}
    for r in got:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(r["text"].split())
    assert taken == {r["doc_id"]: r["n"] for r in plain}
    tables.clear()
    twice = mixed([*rows, *rows[:20], (None, "", "en", "a", 0), (None, "", "en", "a", 0)])
    assert any("doc" in c for c in tables) and sum(len(r["text"].split()) for r in twice) == round(1.5 * sum(len(x[1].split()) for x in [*rows, *rows[:20]]))


def test_mixing_against_the_line_of_words(spark):
    """Each pass takes each word of a source once at most, whole passes all of them; shards get the tree's quotas."""
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(i * 7 % 50)), "en", ("a", "b", None)[i % 3 if i % 2 else 0], 0) for i in range(200)]
    clash = {"row": 1, "h": 2, "bucket": 3, "doc": 4, "rank": 5, "size": 6, "pieces": 7}
    docs = spark.createDataFrame(rows, DOCS)
    for c, x in clash.items():
        docs = docs.withColumn(c, F.lit(x))
    texts = mixing.mixed_texts(docs, block_words=16, shard_blocks=8).collect()
    assert all({c: r[c] for c in clash} == clash for r in texts)
    taken: dict = {}
    for r in texts:
        for w in r["text"].split():
            taken[w] = taken.get(w, 0) + 1
    mixed = mixing.mix(docs, block_words=16, shard_blocks=8).collect()
    for s in ("a", "b", None):
        own = [r for r in mixed if r["source"] == s]
        n = [taken.get(w, 0) for r in own for w in r["text"].split()]
        passes, rest = divmod(round(own[0]["target"]), own[0]["source_size"])
        assert set(n) <= {passes, passes + 1} and sum(x == passes + 1 for x in n) == rest
        assert sum(n) == sum(p["n_words"] for r in own for p in r["pieces"])
    shards = {r["shard"] for r in texts}
    assert len(shards) > 8 and sorted(map(str, texts)) == sorted(map(str, mixing.mixed_texts(docs.repartition(7), block_words=16, shard_blocks=8).collect()))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 97, 128])
def test_permutations_are_bijections(spark, n):
    got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(1), F.lit(2))).collect()]
    assert sorted(got) == list(range(n)) and (n < 10 or got != list(range(n)))


def test_a_permutation_of_1000003_blocks(spark):
    n = 1_000_003
    some = spark.range(0, n, 1, 8).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(1), F.lit(2)).alias("x"))
    assert some.agg(F.countDistinct("x"), F.min("x"), F.max("x")).first() == (n, 0, n - 1)


def test_packing_holds_every_token_once(spark):
    docs = odd_docs(spark)
    pieces = packing.pack(docs, TOKENIZER, window=256, shard_docs=4).collect()
    t = Tokenizer.from_file(TOKENIZER)
    want = sorted(np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u2").tobytes() for r in docs.collect() if r["doc_id"] not in (4,))
    by: dict = {}
    for p in sorted(pieces, key=lambda p: p["start"]):
        if p["doc_id"] != 4:
            by.setdefault(p["doc_id"], []).append(bytes(p["ids"]))
        assert zlib.crc32(np.frombuffer(p["ids"], "<u2").astype("<u4").tobytes()) == p["ids_crc32"]
    assert sorted(b"".join(x) for x in by.values()) == want
    sums: dict = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == sums.get(p["sequence_id"], 0)
        sums[p["sequence_id"]] = p["offset"] + p["length"]
    assert all(n <= 256 and n & (n - 1) == 0 for n in sums.values())
    assert packing.pack(empty(spark), TOKENIZER).count() == 0


def test_label_model_keeps_to_the_labels():
    """Votes that agree with each other on clean rows don't become the class, whatever their number."""
    patterns = np.array([[1, 1, -1, -1], [-1, -1, 1, 1], [0, 0, 0, 0]])
    counts, marked = np.array([1500.0, 1000.0, 7500.0]), np.array([[140, 5], [3, 100], [740, 2]])
    assert (toxicity.LabelModel(patterns, counts, marked).of(patterns) >= 0.5).tolist() == [False, True, False]
    free = toxicity.LabelModel(patterns, counts)
    assert np.allclose(free.of(patterns), toxicity.LabelModel(patterns, counts, np.zeros((3, 2))).of(patterns))


def test_toxicity(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    got = toxicity.toxicity(odd_docs(spark).withColumn("score", F.lit("clash")), labels).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(empty(spark), labels.limit(0)).count() == 0


def test_jaccard_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 50, 60).tolist() for _ in range(4)]
    texts = []
    for i in range(60):
        words = list(base[i % 4])
        for _ in range(i % 6):
            words[rng.integers(0, 60)] = 99
        texts.append(" ".join(map(str, words)))
    rows = [(i, t, None, None, 0) for i, t in enumerate([*texts, None, "", "a b", "A B"])]
    sets = [{tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if (w := (t or "").lower().split()) else set() for _, t, *_ in rows]
    comp = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, DOCS), k=4, num=85).collect()}
    assert got == {i: (len(s), comp[i]) for i, s in enumerate(sets)}
    assert jaccard_join.jaccard_join(empty(spark)).count() == 0


def test_chat_parts():
    text, a, b, found = chat_format.format_turn("assistant", [{"type": "text", "text": "x </turn> \\"}, {"type": "image", "ref": "i.png", "width": 56, "height": 28}])
    assert chat_format.read_turn(text) == ("assistant", "x </turn> \\") and found == [{"type": "image", "number": 0, "ref": "i.png", "tokens": 2}]
    assert hashlib.sha256(chat_format.unescape(chat_format.escape("<\\>")).encode()).hexdigest() == hashlib.sha256(b"<\\>").hexdigest()


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = odd_docs(spark).withColumn("extra", F.lit(1))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "secret_scan", "mixing", "packing"]
    once = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert sorted(str(r["doc_id"]) for r in once.collect()) == ["0", "1", "2", "3", "4", "6", "7", "None"]
    redacted = {r["doc_id"]: r["text"] for r in corpus_pipeline.redact_secrets(spark, docs, SF).collect()}
    assert redacted[7].startswith("[assign] <|endoftext|>") and redacted[0] is None


def test_stages_carry_columns_whose_names_clash(spark):
    import corpus_pipeline

    names = ("size", "shard", "score", "blob", "findings", "mark", "rows", "doc", "body", "_id", "_h", "row", "pieces", "component", "node")
    docs = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i}", "en", "ab"[i % 2], 0) for i in range(6)], DOCS)
    for c in names:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.count()
        assert all(r[c] == f"own {c}" for r in got.collect() for c in names)
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.pack_windows(spark, docs.limit(0), SF).count() == 0


def test_rows_that_share_an_id_are_copies_by_their_texts_alone(spark):
    import corpus_pipeline

    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(None, one), (None, two), (None, None), (None, ""), (1, two), (2, three), (3, two + " more"), (4, one), (4, three + " b"), (4, "alone with its id"), (4, "alone with its id")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    kept = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()), key=str)
    assert kept == sorted([(None, None), (None, ""), (1, two), (2, three), (4, one), (4, "alone with its id")], key=str)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(docs.filter("doc_id is null or doc_id <> 4")).collect()}
    assert got == {(None, 36, None), (None, 36, 1), (None, 0, None), (1, 36, 1), (2, 36, 2), (3, 37, 1)}


def test_html_keeps_headings_and_sections_with_telling_slugs(spark):
    page = """<body><nav>Menu</nav><article><h1>T{0}</h1><h2>Summary</h2><p>Text {0} of this page</p><h2 id="side-effects">Side effects</h2><p class="legal-text">Legal {0}</p>
      <section id="discussion"><h3 id="market-share">Market share</h3><p>More {0}</p></section><section id="related-work"><p>Known {0}</p></section>
      <p>As <math><mi>x</mi><mo>=</mo><mn>{0}</mn><annotation>x=</annotation></math> holds</p><div class="cookie-notice">Cookies</div><div id="post-comments">Reader</div></article></body>"""
    rows = [(i, f"http://h/{i}", page.format(i)) for i in range(5)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"T{i}\nSummary\nText {i} of this page\nSide effects\nLegal {i}\nMarket share\nMore {i}\nKnown {i}\nAs x={i} holds" for i in range(5)}


def test_html_marks_by_words_beyond_the_label():
    many = " ".join(f"{c}-utility" for c in "abcdefghi")
    page = f'<body><div class="{many} sidebar"><p>Side {"text " * 40}</p></div><div class="{many}" itemprop="articleBody"><p>Article</p><div class="{many} advert">Buy</div></div></body>'
    assert html_extract.main_text(page, None) == "Article"


def test_packing_asks_by_all_terms_of_a_seed():
    terms = np.arange(40, dtype=np.uint16)
    idf = np.linspace(1, 9, 100)
    pool = packing.Pool([(0, 40, 0, terms), (1, 3, 0, terms[:3] + 50), (2, 3, 0, np.array([0, 60, 61], np.uint16))], idf, 20.0)
    pool.take(0, 40)
    assert next(pool.neighbours(0)) == 2


@pytest.mark.parametrize("page, want", [
    ('<body><article><div title="a < b">Text</div></article></body>', "Text"),
    ('<body><article><p class="share-price">Price 3</p><div class="side-effects">Nausea</div></article></body>', "Price 3\nNausea"),
    ('<body><article><p>Body</p><ul><li><a href="/a">Ref one</a></li><li><a href="/b">Ref two</a></li></ul></article></body>', "Body\nRef one\nRef two"),
    ('<body><article><p>Seen</p><p style="display: none">Not seen</p><div hidden>Nor</div></article></body>', "Seen"),
    ("<body>" + "<div>" * 150 + "<p>One</p><p>Two</p>" + "</div>" * 150 + "</body>", "One\nTwo"),
    ('<body><article><p data-class="sidebar" title="class=advert">In</p></article></body>', "In"),
    ('<body><article><p class="a"">Stray</p><p title="x>Open</p></article></body>', "Stray\nOpen"),
    ("<body><article><p>" + "long " * 30000 + "</p></article></body>", ("long " * 30000).strip()),
])
def test_html_of_one_page(page, want):
    assert html_extract.main_text(page, None) == want


def test_wrappers_decide_where_names_dont(spark):
    """The host's wrapper drops long and short constants without telling names, and is what differs from reading each page
    alone; a sidebar stays out, however long."""
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    notice = "We keep what you read for as long as we like. " * 8
    plain = "<body><div class=c><p>{0}</p><div>%s</div><p>Follow us</p><p>{0} end</p></div></body>" % notice
    named = "<body><p>x{1}</p><div class=sidebar><p>{0}</p></div></body>"
    rows = [(i, "http://plain/" + str(i), plain.format(words(i), i)) for i in range(5)] + [(i + 10, "http://named/" + str(i), named.format(words(i), i)) for i in range(5)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{words(i)}\n{words(i)} end" for i in range(5)} | {i + 10: f"x{i}" for i in range(5)}
    alone = {i: html_extract.main_text(p, None) for i, _, p in rows}
    assert all(alone[i] != got[i] for i in range(5))
