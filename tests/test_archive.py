import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspan.functions import text as tx
from quillspan.functions.keys import norm_key, strip
from quillspan.operators import audit, catalog, chunking, federation, fulltext, packs, vault, web, windows
from quillspan.sources import files


def test_chunks_like_splitlines(spark):
    texts = ["one\ntwo\nneedle phrase\nfour\nfive\n", "a\r\nb\rc\x0bd e", "", "   ", None, "\n\n\nx", "p1\fp2\f \fp4", "q" * 5000 + "\n" * 300]
    df = spark.createDataFrame([(str(i), f"s{i}", t) for i, t in enumerate(texts)], "item_id string, sha256 string, text string")
    got = {}
    for r in chunking.chunk_texts(df, lines=2).collect():
        got.setdefault(int(r.item_id), []).append((r.ordinal, r.body, r.location.start_line, r.location.end_line, r.location.page))
    for i, t in enumerate(texts):
        want, n = [], 0
        if t and "\f" in t:
            parts = [(p.strip(), None, None, k) for k, p in enumerate(t.split("\f"), 1)]
        else:
            ls = (t or "").splitlines()
            parts = [("\n".join(ls[a : a + 2]).strip(), a + 1, min(len(ls), a + 2), None) for a in range(0, len(ls), 2)]
        for body, a, b, p in parts:
            if body:
                want.append((n, body, a, b, p))
                n += 1
        assert sorted(got.get(i, [])) == want


def test_strip_and_keys(spark):
    df = spark.createDataFrame([(" \t Ab  ",), ("\x1c",), (None,)], "v string")
    assert [r[0] for r in df.select(strip("v")).collect()] == ["Ab", "", None]
    assert [r[0] for r in df.select(norm_key("v")).collect()] == ["ab", None, None]


def test_deadlines(spark):
    vals = ["2024-01-02", "2024-01-02T03:04:05Z", "2024-01-02 03:04+02:00", "2030", "2030-1-1", "eventually", None, "2024-02-30"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(tx.deadline_us(F.col("v"))).collect()]
    day = 1704153600000000
    assert got == [day, day + 11045 * 10**6, day + (3 * 3600 + 240 - 7200) * 10**6, None, None, None, None, None]


def test_ranking_matches_a_plain_computation(spark):
    import math

    docs = [("a", "valve valve line"), ("b", "valve"), ("c", "pump line low pressure"), ("d", "café pressure low")]
    rows = spark.createDataFrame([(k, k, k, "s", ["t"], body) for k, body in docs], "item_id string, chunk_id string, title string, source string, tags array<string>, body string")
    t = fulltext.token_rows(rows)
    got = {r.item_id: r.score for r in fulltext.bm25(t, "line").collect()}
    dl = {k: 3 + len(body.split()) for k, body in docs}
    avg = sum(dl.values()) / 4
    idf = max(math.log((4 - 2 + 0.5) / 2.5), 0) or 1e-6
    want = {k: round(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl[k] / avg)), 6) for k in ("a", "c")}
    assert got == pytest.approx(want)
    assert {r.item_id for r in fulltext.bm25(t, "low-pressure").collect()} == {"c"}
    assert {r.item_id for r in fulltext.bm25(t, "cafe").collect()} == {"d"}
    assert fulltext.bm25(t, "!!").count() == 0


def _bundle(spark, bodies, query, seed=0, shown="", **kw):
    sha = "a" * 64
    items = spark.createDataFrame([("i", kw.pop("live", sha))], "item_id string, sha256 string")
    chunks = spark.createDataFrame([("i", f"c{k}", k, b) for k, b in enumerate(bodies)], "item_id string, chunk_id string, ordinal int, body string")
    rows = spark.createDataFrame(
        [("i", f"c{seed}", sha, shown, "full_text"), ("i", None, sha, "m", "metadata"), ("i", "gone", sha, "g", "full_text"), ("x", "c0", "zz", None, "full_text")],
        "item_id string, chunk_id string, sha256 string, snippet string, retrieval_method string",
    )
    got = {(r.item_id, r.chunk_id): r for r in windows.expand_evidence(rows, items, chunks, query, **kw).collect()}
    assert len(got) == 4 and all(r.windowed is None and r.chunk_ids is None for k, r in got.items() if k != ("i", f"c{seed}"))
    return got["i", f"c{seed}"]


def test_windows_of_sections(spark):
    bodies = ["# Pump\nintro text", "## Valve care v1.4\noil it\nweekly\n### Seals\nnone leak", "## Other\nend of it"]
    r = _bundle(spark, bodies, "the Valve care", seed=1)
    assert r.snippet == "## Valve care v1.4\noil it\nweekly\n### Seals\nnone leak" and r.chunk_ids == ["c1"] and r.windowed and not r.window_truncated
    # a section that goes on into the next chunk; one that is too long is cut at a break
    r = _bundle(spark, ["## Valve care\n" + "word " * 30, "more " * 30, "# Next"], "valve", most=300)
    assert r.snippet.startswith("## Valve care") and len(r.snippet) <= 300 and r.snippet.endswith("more") and r.window_truncated and r.chunk_ids == ["c0", "c1"]
    # all that the query tells must be in the heading
    assert _bundle(spark, ["## Valve\ntext", "x" * 90], "valve pump", most=80).window_truncated


def test_windows_around_words(spark):
    body = "first line here\n" + "filler words " * 60 + "the needle phrase stands here " + "tail words " * 60
    r = _bundle(spark, [body], "Needle  phrase", most=120)
    assert "needle phrase" in r.snippet and len(r.snippet) <= 120 and r.window_truncated
    # without the words the middle of the seed is shown
    assert _bundle(spark, [body], "absent", most=120).snippet in body
    # at most so many chunks, the seed among them
    r = _bundle(spark, [f"{k} ab" for k in range(9)], "ab", seed=4, most=480, max_chunks=2)
    assert len(r.chunk_ids) == 2 and "c4" in r.chunk_ids and r.window_truncated


def test_windows_that_stay(spark):
    # a live item of another digest, and a longer text already shown
    assert _bundle(spark, ["abc needle"], "needle", live="b" * 64).windowed is None
    r = _bundle(spark, ["abc needle"], "needle", shown="a longer text than that")
    assert r.windowed is None and r.snippet == "a longer text than that"
    with pytest.raises(ValueError):
        _bundle(spark, ["a"], "  ")
    with pytest.raises(ValueError):
        _bundle(spark, ["a"], "a", most=79)
    assert windows.telling("how is the v1.4 x") == ["v1.4"] and windows.telling("the") == ["the"]


def test_snippets_like_a_full_text_engine(spark):
    import random
    import sqlite3

    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table t using fts5(body)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text engine")
    rng = random.Random(8)
    words = "valve pump line of the a night watch Straße café low-pressure v1.4 end. next: x".split()
    bodies = [" ".join(rng.choice(words) + rng.choice(["", "", ",", ".", ":", "\n"]) for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    con.executemany("insert into t values (?)", [(b,) for b in bodies])
    n = 0
    for query in ("valve", "pump line", "low-pressure", "v1.4 night", "cafe the of", "next x"):
        terms = fulltext.query_terms(query)
        rows = con.execute("select body, snippet(t, 0, '', '', ' … ', 28) from t where t match ?", (" AND ".join(f'"{t}"' for t in terms),))
        for body, want in rows:
            n += 1
            assert fulltext.snippet(body, [fulltext.phrase(t) for t in terms]) == " ".join(want.split())
    assert n > 100


def test_index_reads_its_terms_alone(spark, tmp_path):
    rows = spark.createDataFrame(
        [(f"i{k}", f"c{k}", f"title {k}", "s", ["t"], f"word{k} valve low pressure" if k % 2 else "pump line") for k in range(40)],
        "item_id string, chunk_id string, title string, source string, tags array<string>, body string",
    )
    index = fulltext.write_index(rows, str(tmp_path / "ix"), buckets=16)
    for query in ("valve", "low-pressure", "pump valve", "word3", "title", "valve valve", "absent", "!!"):
        want = {r.chunk_id: r.score for r in fulltext.bm25(fulltext.token_rows(rows), query).collect()}
        assert {r.chunk_id: r.score for r in index.search(query).collect()} == pytest.approx(want)
    plan = index.postings(["word3"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+", plan) and "EqualTo(term,word3)" in plan
    empty = fulltext.write_index(rows.limit(0), str(tmp_path / "none"))
    assert empty.search("valve").count() == 0 and empty.stats().first().n_rows == 0
    got = fulltext.with_snippets(fulltext.top(index.search("word3"), 5), rows, "word3").collect()
    assert [r.snippet for r in got] == ["word3 valve low pressure"]


def test_ingest_plan(spark):
    schema = "path string, sha256 string, source string, source_uri string, bytes long, ignore boolean"
    f = spark.createDataFrame([("a", "1", "s", None, 5, False), ("b", "1", "s", None, 5, False), ("c", "2", "s", "u", 5, False), ("d", "3", "s", None, 99, False), ("e", "4", "s", None, 5, True)], schema)
    known = spark.createDataFrame([("2", "s", "u", "published"), ("1", "s", None, "rejected")], "sha256 string, source string, source_uri string, state string")
    got = {r.path: (r.action, r.reason) for r in catalog.ingest_plan(f, known, max_bytes=50).collect()}
    assert got == {"a": ("staged", None), "b": ("skipped", "already_present"), "c": ("skipped", "already_present"), "d": ("skipped", "file_too_large"), "e": ("skipped", "sidecar_ignore")}
    dry = {r.path: r.action for r in catalog.ingest_plan(f, known, dry_run=True, max_bytes=50).collect()}
    assert dry["a"] == dry["b"] == "planned_stage"


def test_federation_isolates_failures(spark):
    df = spark.createDataFrame([("web", f"u{i}", f"t{i}", "s", "") for i in range(5)], federation.RESULT)

    def broken():
        raise OSError("down")

    late = spark.createDataFrame([(1,)], "n int").select(F.raise_error(F.lit("late")).cast("string").alias("uri"), F.lit("t").alias("title"))
    rows, status = federation.federate({"a": broken, "web": df, "zim": None, "late": late}, 2)
    assert status.pop("late").startswith("error: ")
    assert rows.count() == 2 and status == {"a": "error: OSError", "web": "ok", "zim": "disabled"}


def test_snapshot_id_ignores_order(spark):
    rows = [(f"i{k}", *["v"] * len(audit.SNAPSHOT_FIELDS)) for k in range(20)]
    cols = ["item_id", *audit.SNAPSHOT_FIELDS]
    a = audit.snapshot_id(spark.createDataFrame(rows, cols)).first()
    b = audit.snapshot_id(spark.createDataFrame(rows[::-1], cols).repartition(3)).first()
    assert a == b and a.n_items == 20


def _catalog(key, fields, **change):
    row = {f: "v" for f in fields} | {key: "x", "tags": ["b", "a"]} | {f: f"d/{f}" for f in fields if f in audit.PATH_FIELDS} | change
    return row, ", ".join(f"{f} {'array<string>' if f == 'tags' else 'string'}" for f in row)


def test_snapshot_sees_every_field(spark):
    import json

    item, schema = _catalog("item_id", audit.SNAPSHOT_FIELDS)
    cand, c_schema = _catalog("candidate_id", audit.CANDIDATE_FIELDS)
    assert set(item) == {
        "item_id", "title", "source", "source_uri", "trust_class", "media_type", "language", "sha256", "storage_path", "extracted_text_path", "imported_at", "published_at",
        "rights_note", "tags", "version_label", "lifecycle_state", "stale_after", "supersedes_item_id", "superseded_by_item_id",
    }
    assert len(cand) == 17

    def changed(row, key):
        """The row and one copy for each other field, with that field changed."""
        for f in row:
            if f != key:
                yield {**row, key: f, f: ["a", "b"] if f == "tags" else f"{row[f]}/new"}

    new = spark.createDataFrame(list(changed(item, "item_id")), schema)
    old = spark.createDataFrame([{**item, "item_id": r["item_id"]} for r in changed(item, "item_id")], schema)
    found = audit.drift(audit.snapshot_records(old), audit.snapshot_records(new)).collect()
    assert {(r.item_id, r.change) for r in found} == {(f, "changed") for f in audit.SNAPSHOT_FIELDS}

    one = spark.createDataFrame([item], schema)
    records = {r.record for r in audit.candidate_records(spark.createDataFrame([{**r, "candidate_id": "x"} for r in [cand, *changed(cand, "candidate_id")]], c_schema)).collect()}
    assert len(records) == 17 and json.loads(min(records))["candidate_id"] == "x"
    ids = [
        audit.snapshot_id(one, candidates=c).first()
        for c in (None, spark.createDataFrame([], c_schema), spark.createDataFrame([cand], c_schema), spark.createDataFrame([{**cand, "state": "new"}], c_schema))
    ]
    assert len({r.snapshot_id for r in ids}) == 4 and [r.n_candidates for r in ids] == [0, 0, 1, 1]


def test_snapshot_paths(spark):
    paths = {"a/b": "a/b", "./a//b": "a/b", "a/../b": "b", "../b": None, "/etc/x": None, "/library-data/a/../c": "c", "/library-data": ".", "": None, "/library-data2/x": None}
    df = spark.createDataFrame([(p,) for p in [*paths, None]], "p string")
    assert {r.p: r.r for r in df.select("p", audit.relative_path(F.col("p")).alias("r")).collect()} == {**paths, None: None}


def test_packs_carry_and_compare_every_field(spark):
    item = {f: "v" for f in packs.MEMBER_FIELDS} | {"tags": ["b", "a"], "sha256": "0" * 64}
    side = {f: "s" for f in packs.SIDECAR_FIELDS}
    schema = ", ".join(f"{f} {'array<string>' if f == 'tags' else 'string'}" for f in item)

    def made(row=item, sidecar=side, size=5):
        rows = spark.createDataFrame([row], schema)
        prov = spark.createDataFrame([{"item_id": "v", **sidecar}] if sidecar else [], "item_id string, " + ", ".join(f"{f} string" for f in side))
        return packs.members(rows, prov, spark.createDataFrame([("0" * 64, size), ("0" * 64, 1)], "sha256 string, bytes long")), rows, prov

    def pack_id(m):
        return packs.manifest_ids(m.withColumn("pack_name", F.lit("p"))).first().pack_id

    m, rows, prov = made()
    got = m.first()
    assert len(got) == 18 and got.payload_bytes == 5 and got.source_provenance.author == "s"
    assert packs.against_library(m, rows, prov).count() == 0
    ids = {pack_id(m), pack_id(made(size=6)[0]), pack_id(made(sidecar=None)[0]), pack_id(made(sidecar={**side, "author": "t"})[0])}
    assert len(ids) == 4
    changes = [{**item, f: ["a", "b"] if f == "tags" else "w"} for f in item if f not in ("item_id", "sha256")]
    assert len(ids | {pack_id(made(row)[0]) for row in changes}) == 4 + len(changes)
    for f in ("version_label", "lifecycle_state", "stale_after", "supersedes_item_id", "superseded_by_item_id"):
        for value in ("w", None):
            assert packs.against_library(m, made({**item, f: value})[1], prov).first().codes == f"drift_{f}"
    for sidecar in (None, {**side, "source_library_imported_at": "t"}):
        assert packs.against_library(m, rows, made(sidecar=sidecar)[2]).first().codes == "drift_source_provenance"


def test_vault(spark):
    df = spark.createDataFrame([("o1", "CACHE"), ("o2", "PERMANENT")], "object_id string, retention string")
    assert [r.retention for r in vault.promote(df, "STANDARD").orderBy("object_id").collect()] == ["STANDARD", "PERMANENT"]
    with pytest.raises(ValueError):
        vault.list_objects(df, limit=0)


def test_pages():
    page = "<html><title>T</title><script>poison</script><h1>Head</h1><p onclick=x>a &amp; b<a href='javascript:1'>l</a></p></html>"
    assert web.visible_text(page) == "T\nHead\na & bl"
    assert "poison" not in web.sanitised(page) and "onclick" not in web.sanitised(page) and "javascript" not in web.sanitised(page)


def test_file_formats(spark, tmp_path):
    def zipped(parts):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for name, data in parts.items():
                z.writestr(name, data)
        return b.getvalue()

    (tmp_path / "a.docx").write_bytes(zipped({"word/document.xml": "<w:d xmlns:w='u'><w:p><w:t>Hello </w:t><w:t>there</w:t></w:p><w:p/></w:d>"}))
    (tmp_path / "b.odt").write_bytes(zipped({"content.xml": "<o xmlns:t='u'><t:h>Head</t:h><t:p>Body</t:p></o>"}))
    opf = "<p><item id='2' href='x2.xhtml'/><item id='1' href='x1.xhtml'/><itemref idref='2'/><itemref idref='1'/></p>"
    box = "<c><rootfile full-path='O/b.opf'/></c>"
    (tmp_path / "c.epub").write_bytes(zipped({"META-INF/container.xml": box, "O/b.opf": opf, "O/x1.xhtml": "<p>first</p>", "O/x2.xhtml": "<p>second</p>"}))
    (tmp_path / "d.txt").write_bytes(b"x\r\ny\xff")
    (tmp_path / "e.docx").write_bytes(b"not a zip")
    (tmp_path / "f.bin").write_bytes(b"\0")
    (tmp_path / "d.txt.meta.json").write_text('{"title": "t", "odd": 1}')
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": ("Hello there", None), "b.odt": ("Head\nBody", None), "c.epub": ("second\nfirst", None), "d.txt": ("x\ny�", None), "e.docx": (None, "BadZipFile")}
    assert files.read_sidecars(spark, str(tmp_path)).first().unknown_fields == ["odd"]
    assert files.list_files(spark, str(tmp_path)).count() == 5


def test_lookup(spark):
    rows = spark.createDataFrame([("lib_a1", "ffff1"), ("lib_a2", "eeee2")], "item_id string, sha256 string")
    wanted = spark.createDataFrame([("lib_a1",), ("lib_a",), ("eeee",), ("none_",), (None,)], "wanted string")
    got = {r.wanted: (r.item_id, r.status) for r in catalog.lookup(rows, wanted, "item_id").collect()}
    assert got == {"lib_a1": ("lib_a1", "exact"), "lib_a": (None, "ambiguous"), "eeee": ("lib_a2", "prefix"), "none_": (None, "not_found")}


def test_canonical_ids_of_documents(spark):
    import hashlib
    import json

    from quillspan.operators import identity

    names = [*audit.SNAPSHOT_FIELDS]
    rows = [{"item_id": k, **{f: f"{f} é/\x01\\u001F \"{k}" for f in names}, "tags": ["b", "a"], "source_uri": None, "storage_path": f"archive/{k}", "extracted_text_path": None} for k in ("b", "a", "é")]
    schema = "item_id string, " + ", ".join("tags array<string>" if f == "tags" else f"{f} string" for f in names)
    items = spark.createDataFrame([tuple(r[f] for f in ["item_id", *names]) for r in rows], schema)
    cands = spark.createDataFrame([], "candidate_id string, " + ", ".join("tags array<string>" if f == "tags" else f"{f} string" for f in audit.CANDIDATE_FIELDS))
    core = {
        "schema": "s.v1", "items": sorted(rows, key=lambda r: r["item_id"]), "candidates": [], "include_candidates": True,
        "canonical_bytes_embedded": False, "canonical_receipt": False, "authority": "none",
    }
    want = "snap_" + hashlib.sha256(json.dumps(core, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert tuple(identity.snapshot_ids(items, cands, "s.v1").first()) == (want, 3, 0)
    none = dict(core, items=[], include_candidates=False)
    empty = "snap_" + hashlib.sha256(identity.canonical(none)).hexdigest()
    assert tuple(identity.snapshot_ids(items.limit(0), None, "s.v1").first()) == (empty, 0, 0)
    bodies = [("good", json.dumps({"snapshot_id": want, "core": core})), ("bad", json.dumps({"snapshot_id": "x", "core": core})), ("none", "{"), ("null", None)]
    got = {r.name: (r.valid, r.n_items) for r in identity.inspect_snapshots(spark.createDataFrame(bodies, "name string, body string")).collect()}
    assert got == {"good": (True, 3), "bad": (False, 3), "none": (False, None), "null": (False, None)}


def test_sidecars_entities_packs_and_shelves(spark, tmp_path):
    import hashlib

    (tmp_path / "a.html").write_text("<title>Own title</title><p>x</p>")
    (tmp_path / "a.html.meta.json").write_text('{"title": "Side", "trust": "owner", "tags": ["x"]}')
    (tmp_path / "b.txt").write_text("b")
    (tmp_path / "b.txt.meta.json").write_text("{broken")
    listed = files.list_files(spark, str(tmp_path)).select("path")
    d = {r.path[-6:]: r for r in files.described(listed, files.read_sidecars(spark, str(tmp_path))).collect()}
    assert (d["a.html"].side_title, d["a.html"].side_trust, d["a.html"].side_tags, d["a.html"].ignore) == ("Side", "owner", ["x"], False)
    assert d["/b.txt"].side_error and d["/b.txt"].side_title is None
    assert {r.emb_title for r in files.read_embedded(spark, str(tmp_path)).collect()} == {"Own title", None}

    pack = tmp_path / "pack"
    sha = [hashlib.sha256(x).hexdigest() for x in (b"one", b"two", b"three")]
    for h, data in zip(sha[:2], (b"one", b"changed")):
        (pack / "objects" / "sha256" / h[:2]).mkdir(parents=True, exist_ok=True)
        (pack / "objects" / "sha256" / h[:2] / h).write_bytes(data)
    import json

    (pack / "manifest.json").write_text(json.dumps({"members": [{"item_id": h, "sha256": h} for h in sha]}))
    got = {tuple(r) for r in files.pack_payload_codes(spark, str(pack)).collect()}
    assert got == {("export_payload_checksum_mismatch", sha[1]), ("missing_export_payload", sha[2])}

    (tmp_path / "log.jsonl").write_text('{"event_id": "1", "v": 2}\nnot json\n')
    assert {(r.event_id, r._corrupt) for r in files.read_events(spark, str(tmp_path / "log.jsonl"), "event_id string, v int").collect()} == {("1", None), (None, "not json")}
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "one.json").write_text('{"name":\n "x"}')
    assert [r.name for r in files.read_entities(spark, str(tmp_path / "e"), "name string").collect()] == ["x"]

    xml = '<f xmlns="u"><entry><title> A  b</title><link href="/c/1"/><summary>s</summary></entry><entry><title>none</title></entry><item><title>T</title><url>x/2</url></item></f>'
    raw = spark.createDataFrame([("k", xml), ("bad", "<"), ("null", None)], "book string, body string")
    got = [tuple(r) for r in files.read_shelf_results(raw, "http://h:1").collect()]
    assert got == [("k", 0, "A b", "http://h:1/c/1", "s"), ("k", 1, "T", "http://h:1/x/2", "")]


def test_sinks(spark, tmp_path):
    from quillspan.sources import sinks

    log = str(tmp_path / "log")
    ev = lambda *ids: spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "event_id string, n int")
    sinks.append_events(ev("a", "b", "a", None), log)
    sinks.append_events(ev("b", "c"), log)
    assert sorted(r.event_id for r in spark.read.json(log).collect()) == ["a", "b", "c"]
    sinks.write_version(ev("a"), str(tmp_path / "v"))
    with pytest.raises(Exception):
        sinks.write_version(ev("a"), str(tmp_path / "v"))
    table = str(tmp_path / "chunks")
    chunk = lambda *rows: spark.createDataFrame(list(rows), "item_id string, body string")
    sinks.reindex(chunk(("x", "1"), ("y", "1"), ("z", "1")), chunk(("x", ""), ("y", ""), ("z", "")), table, buckets=2)
    sinks.reindex(chunk(("x", "2"), ("x", "3")), chunk(("x", ""), ("y", "")), table, buckets=2)
    assert sorted((r.item_id, r.body) for r in spark.read.parquet(table).collect()) == [("x", "2"), ("x", "3"), ("z", "1")]


def test_pages_and_addresses(spark):
    page = "<title>T</title><svg><p>no</p></svg><form><p onclick='x'>a &amp; <b>b</b></p></form><a href=' https://x.example/ '>l</a><a href='javascript:1'>m</a><br/>"
    assert web.cleaned(page) == ('<p>a &amp; <b>b</b></p><a href="https://x.example/">l</a><a>m</a><br>', "a & b l m", "T")
    assert web.cleaned("") == ("", "", "") and web.cleaned("x") == ("x", "x", "")
    assert web.read_page("<title>T</title><tbody>a<tfoot>b\u00a0 c<script><p>x</script>") == ("T\na\nb\u00a0 c", "T")
    ips = {"10.1.1.1": True, "8.8.8.8": False, "::1": True, "fe80::1": True, "2606:4700::1": False, "224.0.0.1": True, "0.0.0.0": True, "x": None, None: None}
    assert {k: web.nonpublic(k) for k in ips} == ips
    df = spark.createDataFrame([("a b/ü*~.txt", "text/HTML; charset=x", "https://h.example/x/A.TGZ?q=1.z"), ("", None, "https://h.example/.hidden")], "p string, t string, u string")
    got = df.select(web.file_address(F.lit("https://f.example/"), F.col("p")), web.safe_suffix(F.col("u"), F.col("t")), web.suffix_of_type(F.col("t"))).collect()
    assert tuple(got[0]) == ("https://f.example/a%20b/%C3%BC%2A~.txt", ".tgz", ".txt") and got[1][1] == ".bin"


def test_sidecar_codes(spark):
    raws = ['{"author": "a"}', '{"permissions": 1}', '{"odd": 1}', '{"acquired_at": "soon"}', "[]", None]
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    got = [r[0] for r in df.select(packs.sidecar_code(F.col("raw"))).collect()]
    assert got == [None, "authority_field:permissions", "unknown_field:odd", "not_a_time:acquired_at", "not_an_object", "not_an_object"]
