import numpy as np
import pyarrow.parquet as pq
import pytest

from quillspan.llm import boilerplate, bpe, leaks, queries, scans, splitting


@pytest.fixture(scope="module")
def encoder():
    return bpe.ByteBpe(bpe.vocabulary_bytes())


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    odd = ["", " ", "a\x1cb  \x85 c", "don't   <|endoftext|> 12½ⅷ é", "ab" * 3000, " " * 5000 + "x", "日本語テキスト🔧", "\n\n \n", "aaaa" * 500]
    return [x for x in t if x] + odd


def test_encoding_is_exact(encoder, texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for x, ref in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert encoder.encode(x).tolist() == ref.ids


def test_round_trip(encoder, texts):
    assert all(encoder.decode(encoder.encode(x)).decode() == x for x in texts)


def test_encoding_of_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, " ", 5)], "doc_id long, text string, ids int")
    assert {r.doc_id: r.ids for r in bpe.encode_column(df).collect()} == {1: [], 2: [], 3: [220]}
    assert bpe.encode_column(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit,overlap", [(512, 64), (60, 10)])
def test_pieces(encoder, texts, limit, overlap):
    for x in texts[:400] + texts[-9:]:
        ids = encoder.encode(x)
        pieces = splitting.split_text(x, encoder, limit, overlap)
        if len(ids) <= limit:
            assert pieces == []
            continue
        assert pieces[0][0] == 0 and pieces[-1][1] == len(ids)
        for a, b, p in pieces:
            assert b - a <= limit and len(encoder.encode(p)) <= limit
            assert encoder.decode(ids[a:b]).decode() == p
        for (_, b, _), (a, _, _) in zip(pieces, pieces[1:]):
            assert overlap <= b - a <= overlap + 3


def test_pieces_end_at_headings(encoder):
    text = "# One\n\n" + "word here. " * 30 + "\n\n# Two\n\n" + "other there. " * 30
    pieces = splitting.split_text(text, encoder, 120, 10)
    assert pieces[0][2].rstrip().endswith("here.") and "# Two" not in pieces[0][2]


def test_siblings_are_merged_bottom_up():
    # levels of the boundaries before tokens 0..29: three blocks, the second oversized
    levels = np.full(31, splitting.INSIDE)
    levels[[0, 6, 24]] = splitting.BLOCK
    levels[[12, 18]] = splitting.SENTENCE
    assert splitting.pack(levels, 0, 30, 12) == [(0, 6), (6, 18), (18, 30)]
    assert splitting.pack(levels, 0, 30, 8) == [(0, 6), (6, 12), (12, 18), (18, 24), (24, 30)]


def test_split_found_is_the_oversized(spark, encoder):
    df = spark.createDataFrame([(1, "word " * 600), (2, "x"), (3, None), (4, ""), (None, "word " * 600)], "doc_id long, text string")
    for hostile in ("a" * 9000, "\U0001f527\u200d" * 900, "\u65e5\u672c\u8a9e" * 1500, "1234567890" * 400, " " * 5000, "\u00e9" * 3000):
        assert max(len(encoder.encode(p)) for _, _, p in splitting.split_text(hostile, encoder)) <= 512
    assert sorted(str(r.doc_id) for r in splitting.split_ids(splitting.split_column(df)).collect()) == ["1", "None"]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute_leaks(docs, items):
    out = set()
    for d, t in docs:
        w = leaks.normal_words(t or "")
        for e, x in items:
            item = leaks.normal_words(x)
            width, need = int(1.5 * len(item)), -(-len(item) // 2)
            # whatever repeats half the item shares at least so many of its words
            if len(set(w) & set(item)) * 4 < len(set(item)):
                continue
            if any(plain_lcs(item, w[i : i + width]) >= need for i in range(0, max(1, len(w) - width // 2), 8)):
                out.add((d, e))
    return out


def test_leaks_against_brute_force(spark, tiny):
    docs, items = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/eval_items.parquet").limit(60)
    got = {tuple(r) for r in leaks.leaked(docs, items).collect()}
    want = brute_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.eval_id, r.text) for r in items.collect()])
    assert got == want
    assert {tuple(r) for r in leaks.leaked(docs, items, block=7).collect()} == got
    assert leaks.leaked(docs.limit(0), items).count() == 0 and leaks.leaked(docs, items.limit(0)).count() == 0


def test_leaks_through_noise():
    item = " ".join(f"word{i}" for i in range(40))
    s = leaks.ItemSet([9], [item])
    assert s.found("intro " + item.upper().replace(" word3 ", " &quot;wörd3&quot;, ") + " tail")
    assert s.found("> " + item.replace("word7 ", "wo-\n> rd7 ").replace("o", "о"))
    assert s.found(" ".join(item.split()[:24]))
    assert not s.found(" ".join(item.split()[:12])) and not s.found("")
    # broken up so that no n-gram is left
    sparse = [w if i % 3 else f"other{i}" for i, w in enumerate(item.split())]
    assert s.found("intro " + " ".join(sparse)) == [0] and s.found(" ".join(item.split()[::2])) == [0]
    assert not s.found(" ".join(item.split()[:38:2])) and not s.found(" ".join(reversed(item.split())))


def test_random_stretches_against_plain_search():
    rng = np.random.default_rng(4)
    vocab = [f"v{i}" for i in range(30)]
    items = [" ".join(rng.choice(vocab, rng.integers(6, 50))) for _ in range(5)]
    s = leaks.ItemSet(list(range(5)), items)
    texts = []
    for _ in range(12):
        k = rng.integers(5)
        w = [x for x in items[k].split() if rng.random() < rng.choice([0.45, 0.55, 0.7])]
        texts.append([*rng.choice(vocab, rng.integers(0, 30)), *w, *rng.choice(vocab, rng.integers(0, 30))])
    for text, got in zip(texts, s.stretches(texts, whole=False)):
        want = set()
        for k, item in enumerate(items):
            item = item.split()
            width, need = int(1.5 * len(item)), -(-len(item) // 2)
            if any(plain_lcs(item, text[i : i + width]) >= need for i in range(max(1, len(text)))):
                want.add(k)
        assert {k for k, _, _ in got} == want


def test_products_and_rare_words_find_the_same():
    rng = np.random.default_rng(7)
    vocab = [f"v{i}" for i in range(200)]
    items = [" ".join(rng.choice(vocab, rng.integers(12, 90))) for _ in range(12)]
    texts = [list(rng.choice(vocab, rng.integers(0, 400))) for _ in range(40)]
    for text in texts[::3]:
        item = items[rng.integers(12)].split()
        text[5:5] = [w for w in item if rng.random() < 0.6]
    a, b = leaks.ItemSet(list(range(12)), items), leaks.ItemSet(list(range(12)), items)
    assert a.by_product
    b.by_product = False
    for whole in (False, True):
        one, two = ([{k for k, _, _ in x} for x in s.stretches(texts, whole)] for s in (a, b))
        assert one == two and any(one)
    # words common to all items leave less than half to be counted one by one
    line = np.array([a.vocab.get(w, 0) for x in texts for w in [*x, *[""] * 110]], np.int64)
    (_, low, high), (_, low_b, high_b) = a._blocks(line), b._listed(line)
    assert (high - low).sum() * 2 < (high_b - low_b).sum()


def test_words_by_one_table():
    assert leaks.normal_words("a\u00b4b \u0149o \u00c9\u0301t\u00e9 \u043e\u0440\u00e6 \u200bx\u00ady \ufb01t \u0130") == ["ab", "no", "ete", "opae", "xy", "fit", "i"]


def test_leaked_stretches_are_taken_out(spark):
    item = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame(
        [(1, f"Before it. {item.upper()}, and after.\nNext {item} end"), (2, "clean text"), (3, None), (4, "")], "doc_id long, text string"
    )
    items = spark.createDataFrame([(9, item), (8, None), (7, "")], "eval_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in leaks.without_spans(docs, items).collect()}
    assert got[1][0] == "Before it.  and after.\nNext  end" and got[1][1] == 2 * len(item) + 1
    assert got[2] == ("clean text", 0) and got[3] == (None, 0) and got[4] == ("", 0)
    spans = leaks.leaked_spans(docs, items).collect()
    assert [(r.doc_id, r.eval_id) for r in spans] == [(1, 9), (1, 9)]


def test_page_labels():
    w = boilerplate.load_weights()
    page = (
        "<div>Fenn Archive</div>\n<ul><li><a href='/a'>Sign in</a></li><li><a href='/b'>Help</a></li></ul>\n<div>\n<h1>Steady valve ledger</h1>\n"
        "<p>The valve was weighed at the end of the season. It runs slowly when the casing is cold.</p>\n<p>Tags: valve, fuse</p>\n</div>\n"
        "<p>Powered by ShelfPress at Yarrowby (build 1991)</p>"
    )
    (got,) = boilerplate.label_pages(w, [(page, "Steady valve ledger – Fenn Archive")])
    assert [leaf.lines for leaf, kept in got if kept] == [(4,), (5,)]
    # the same page on one line, with broken tags, comments and scripts
    def kept(p):
        return [leaf.text for leaf, k in boilerplate.label_pages(w, [(p, "Steady valve ledger – Fenn Archive")])[0] if k]

    article = kept(page)
    assert len(article) == 2 and kept(page.replace("\n", "")) == article
    odd = page.replace("<p>The", "<!-- <p>no -->\n<script>\nvar a = '<p>track()</p>';</script><p\nclass='x'>The").replace("</p>", "</p\n>")
    assert kept(odd) == article
    assert boilerplate.label_pages(w, [("", ""), (" \n", "x"), (page * 40, "")])[0] == []


def test_leaves_of_markup():
    page = "<ul><li>a<li>b <b>c</b></ul><pre>x\n  y</pre><div>one <span>two</span> three<br>four</div><div><span>p</span><span>q</span></div><table><tr><td>1</td><td>2</td></tr></table>&lt;z&gt;"
    got = boilerplate.leaves(page)
    assert [leaf.text for leaf in got] == ["a", "b c", "x", "y", "one two three", "four", "p", "q", "1 2", "<z>"]
    assert [leaf.lines for leaf in got][2:4] == [(1,), (2,)]
    assert boilerplate.leaves("<p>one\ntwo</p>")[0].lines == (1, 2)
    assert boilerplate.leaves("") == boilerplate.leaves("<script>x") == boilerplate.leaves("<!-- x") == []
    long = boilerplate.features(boilerplate.leaves("<p>" + "word " * 5000 + "</p>"))
    assert len(long.words) == 9999


def test_text_stands_for_html(spark):
    schema = "page_id long, html string, title string, loaded_at timestamp, text string"
    text = "The valve was weighed at the end of the season. It runs slowly when the casing is cold, and the log is kept in the reading room."
    df = spark.createDataFrame([(1, None, "Valve", None, text), (2, None, "t", None, None), (3, None, "t", None, " ")], schema)
    assert [r.page_id for r in boilerplate.article_text(df).collect()] in ([1], [])
    assert boilerplate.article_lines(df).count() == 0


def test_pages_of_odd_tables(spark):
    schema = "page_id long, html string, title string, loaded_at timestamp, text string"
    df = spark.createDataFrame([(1, None, None, None, "x"), (2, "", "t", None, None), (None, "<p>a</p>", "t", None, None)], schema)
    assert boilerplate.article_lines(df).count() == 0 and boilerplate.article_lines(df.limit(0)).count() == 0


WORDS = scans.Words({w: 50 for w in "the governor must be drained after every long haul low-pressure low pressure line and a of is kept in reading room item supersedes".split()})


def test_scan_repair():
    pages = [
        (0, "— Steady valve ledger —\n\nThe govcrnor must be dra-\nined after every long haul. The low-\npressure line is kept\n[7]"),
        (1, "— Steady valve ledger —\nin the reading room. Item BML-\n5359 supersedes the r e a d i n g ro¬\nom.\n\n[8]"),
        (2, "_______\n— Steady vaIve ledger —\nA haul is kept.\n[9]"),
    ]
    found, paras = scans.repair(pages, WORDS, "Steady valve ledger")
    kinds = {k: sorted((o, i) for o, i, x in found if x == k) for k in ("furniture", "hyphen", "ocr")}
    assert kinds["furniture"] == [(0, 1), (0, 6), (1, 1), (1, 6), (2, 1), (2, 2), (2, 4)]
    assert kinds["hyphen"] == [(0, 3), (1, 3)] and kinds["ocr"] == [(0, 3)]
    text = " ".join(p for _, p in paras)
    assert "governor must be drained after" in text and "BML-5359" in text and "low-pressure line is kept in the reading room" in text


def test_scan_splits_are_decoded_with_their_neighbours():
    words = scans.Words({w: 50 for w in "the governor must be drained after every long haul in read reading room item kept rep a is line supersedes".split()})
    read = lambda *t: scans.read_lines([((1, k), x) for k, x in enumerate(t)], words)
    # first piece a known word; first piece long; pieces on two lines; split and cut; split, misread and cut
    assert read("the read ing room")[2] == [["the", "reading", "room"]]
    assert read("the super sedes, line")[2] == [["the", "supersedes,", "line"]]
    assert read("the gover", "nor must")[2] == [["the", "governor"], ["must"]]
    cut, misread, fixed = read("the gov er-", "nor, must")
    assert fixed == [["the", "governor,"], ["must"]] and cut == {(1, 0): True} and not misread
    cut, misread, fixed = read("the gov er-", "n0r must be")
    assert fixed == [["the", "governor"], ["must", "be"]] and cut and misread == {(1, 1): True}
    assert read("is the\u00ac", "zzq must")[0] == {(1, 0): True}
    # run together; pieces that are words of their own
    assert read("the governorroom item")[2] == [["the", "governor", "room", "item"]]
    rare = scans.Words({"the": 9_000_000, "of": 9_000_000, "example": 900_000, "ex": 1, "ample": 1})
    assert scans.read_lines([((1, 0), "the ex ample of")], rare)[2] == [["the", "example", "of"]]
    # what is known stays
    assert read("the long haul is in", "the room")[2] == [["the", "long", "haul", "is", "in"], ["the", "room"]]
    assert read("a zyxqwv-", "kjhgf. The")[2] == [["a", "zyxqwvkjhgf."], ["The"]]


def test_paragraphs_of_any_length():
    lines = [("Word after word.", "Word after word and so on to the end of it.", k == 1200) for k in range(2400)]
    assert [p.count("after") for p in scans.paragraphs(lines)] == [1200, 1200]


def test_scan_tables_with_odd_rows(spark):
    schema = "item_id string, ordinal int, body string, location struct<kind: string>, loaded_at timestamp"
    df = spark.createDataFrame([("a", 0, None, ("page",), None), ("a", 1, "", ("page",), None), ("b", None, "x", ("page",), None), (None, 0, "x", ("page",), None), ("c", 0, "x", ("lines",), None), ("d", 0, "x", None, None)], schema)
    items = spark.createDataFrame([("a", "t")], "item_id string, title string")
    assert scans.noise_lines(df, items, {}).count() == 0
    assert scans.noise_lines(df.limit(0), items, {"a": 1}).count() == 0


def test_long_items_are_split_into_blocks(spark):
    rows = [("a", i, f"Head of book\nThe line is kept and the line is kept.\n[{i + 3}]", ("page",), None) for i in range(3 * scans.BLOCK_PAGES)]
    df = spark.createDataFrame(rows, "item_id string, ordinal int, body string, location struct<kind: string>, loaded_at timestamp")
    items = spark.createDataFrame([], "item_id string, title string")
    got = scans.noise_lines(df, items, WORDS.counts).collect()
    assert len(got) == len({tuple(r) for r in got}) == 2 * len(rows) and {r.kind for r in got} == {"furniture"}


def test_every_query_is_named(spark):
    assert {"p1_found", "p3_found", "p4_found", "p8_ids", "p9_found", "p10_found"} <= set(queries.queries())
