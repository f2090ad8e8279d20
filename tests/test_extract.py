"""Extractors in processes of their own, files of pages as a data source, and files that tasks write."""

import functools
import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceWriter

from quire.config import Config
from quire.plans import cli, runs
from quire.sources import extract, files, filesink, paged, reader
from quire.sources.extract import FakeExtractor
from tests import extractors


def own_reader(make):
    return reader.Reader(reader.packed(make))


def put(tmp_path, **texts):
    for name, text in texts.items():
        (tmp_path / name.replace("__", ".")).write_text(text)
    return {name: str(tmp_path / name.replace("__", ".")) for name in texts}


def listed(spark, paths, kind="pdf"):
    rows = [("book", f"file:{p}", os.path.basename(p).rpartition(".")[0], kind, i) for i, p in enumerate(sorted(paths))]
    return spark.createDataFrame(rows, "doc_id string, path string, stem string, kind string, ord int")


def told(folder):
    path = os.path.join(str(folder), "told")
    return [x.split() for x in open(path).read().splitlines()] if os.path.exists(path) else []


def gone(pid):
    try:
        os.kill(int(pid), 0)
    except ProcessLookupError:
        return True
    return open(f"/proc/{pid}/stat").read().split()[2] == "Z"


def test_a_hung_reader_is_gone_before_the_retry(tmp_path):
    path = put(tmp_path, a__jpg="HANG here")["a__jpg"]
    own = own_reader(functools.partial(extractors.Telling, str(tmp_path)))
    assert extract.read_page(own, path, 1, timeout=2) == ("HANG here", None, True)
    first, second = [pid for what, pid in told(tmp_path) if what == "made"]
    assert first != second and gone(first) and not gone(second) and own.starts == 2
    assert [w for w, _ in told(tmp_path)] == ["made", "began", "made", "began", "ended"]  # noise doesn't reach the replies
    own.close()
    assert gone(second)


def test_a_child_that_dies_is_a_failed_page(tmp_path):
    at = put(tmp_path, a__jpg="CRASH", b__jpg="fine", c__jpg="BROKEN", d__jpg="  ")
    own = own_reader(FakeExtractor)
    assert extract.read_page(own, at["a__jpg"], 1) == (None, "the extractor's process ended (3)", False)
    assert extract.read_page(own, at["b__jpg"], 1) == ("fine", None, False) and own.starts == 2
    assert extract.read_page(own, at["c__jpg"], 1, timeout=5) == (None, "broken page", False) and own.starts == 2
    assert extract.read_page(own, at["d__jpg"], 1)[1] == "empty result"
    assert "No such file" in extract.read_page(own, str(tmp_path / "nowhere.jpg"), 1)[1]
    own.close()


def test_an_extractor_that_cannot_be_made_is_tried_once(tmp_path):
    own = own_reader(extractors.unmakeable)
    for _ in range(3):
        with pytest.raises(reader.NoExtractor, match="the model isn't there"):
            own.ask("pages", "x")
    assert own.starts == 1


def test_slots_bound_what_works_at_once():
    name = f"quire-test-{os.getpid()}"
    with reader.Slot(2, name), reader.Slot(2, name):
        third = reader.Slot(2, name)
        held = time.perf_counter()
        import threading

        t = threading.Thread(target=third.__enter__)
        t.start()
        t.join(0.2)
        assert t.is_alive()
    t.join(5)
    assert third.held is not None and time.perf_counter() - held > 0.2
    third.__exit__()
    with reader.Slot(0, name) as free:
        assert free.held is None


def test_one_extractor_a_worker_and_none_without_pages(spark, tmp_path):
    at = put(tmp_path, **{f"p{i:02}__jpg": f"page {i}" for i in range(24)})
    make, config = functools.partial(extractors.Telling, str(tmp_path)), Config(keep_html=True, n_parallel=4, figures_dir=str(tmp_path / "f"))
    rows, parts = listed(spark, at.values(), "image"), str(tmp_path / "out" / "parts")
    done = runs.run(spark, config, rows, make, parts)
    assert (done.total, done.skipped, done.done, done.errors) == (24, 0, 24, 0)
    made = [pid for what, pid in told(tmp_path) if what == "made"]
    assert 1 <= len(made) == len(set(made)) <= 8 and len([1 for w, _ in told(tmp_path) if w == "ended"]) == 24
    again = runs.run(spark, config, rows, make, parts)  # nothing to do: no extractor, no batch, no raw texts
    assert (again.total, again.skipped, again.done) == (24, 24, 0) and again.metrics.count() == 0
    assert [pid for what, pid in told(tmp_path) if what == "made"] == made
    assert [n for n in os.listdir(parts) if not n.startswith(("_", "."))] == ["batch=000000000000"] and os.listdir(f"{parts}-raw") == []


def test_n_parallel_bounds_an_executor(spark, tmp_path):
    at = put(tmp_path, **{f"p{i:02}__jpg": f"SLOW {i}" for i in range(6)})
    pages = extract.page_list(extract.file_pages(listed(spark, at.values(), "image"), FakeExtractor)).repartition(6, "path")
    make = functools.partial(extractors.Telling, str(tmp_path))
    assert extract.extract_pages(pages, make, parallel=1).count() == 6
    assert [w for w, _ in told(tmp_path) if w != "made"] == ["began", "ended"] * 6
    # on a cluster the scheduler holds tasks back: the profile is in the plan
    assert extract.bounded("local[8]", 8, 2) is None and extract.bounded("spark://x:1", 8, 0) is None and extract.bounded("spark://x:1", 2, 2) is None
    plan = extract.extract_pages(pages, make, parallel=3, profile=extract.bounded("spark://x:1", 8, 3))._jdf.queryExecution().analyzed()
    while plan.nodeName() != "MapInArrow":
        plan = plan.children().apply(0)
    assert plan.profile().get().taskResources().apply("cpus").amount() == 3.0


def test_unreadable_files_are_reported(spark, tmp_path, caplog):
    at = put(tmp_path, a__pdf="one\ftwo", b__pdf="UNOPENABLE", c__pdf="three")
    done = runs.run(spark, Config(keep_html=True), listed(spark, at.values()), FakeExtractor, str(tmp_path / "parts"))
    assert (done.total, done.done, done.errors) == (3, 3, 0) and "Failed to open" in caplog.text and "b.pdf" in caplog.text
    assert sorted(r["page_id"] for r in done.pages.collect()) == ["a_p001", "a_p002", "c_p001"]


def test_no_content_is_shuffled(spark, tmp_path):
    rows = listed(spark, put(tmp_path, a__pdf="one\ftwo").values())
    pages = extract.page_list(extract.file_pages(rows, FakeExtractor))
    for df in (pages, extract.extract_pages(pages, FakeExtractor), extract.pdf_classes(extract.file_pages(rows, FakeExtractor), FakeExtractor)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        below = [line for line in plan.splitlines() if "binary" in line.lower() or "content#" in line]
        assert all("Exchange" not in line for line in below) and "binaryFile" not in plan


def test_paged_files(spark, tmp_path):
    put(tmp_path, a__pdf="one\ftwo FIGURE\fthree", b__PDF="UNOPENABLE", c__pdf="BROKEN\flast", d__txt="no")
    (tmp_path / "e.pdf").write_text("\f".join(f"page {i} " + "x" * 1000 for i in range(1, 101)))
    plain = paged.read_files(spark, str(tmp_path), FakeExtractor)
    assert plain.columns == ["path", "n_pages", "page", "error"]
    rows = {(os.path.basename(r["path"]), r["page"]): (r["n_pages"], r["error"]) for r in plain.collect()}
    assert len(rows) == 3 + 1 + 2 + 100 and rows["b.PDF", None] == (None, "not a file of pages") and rows["a.pdf", 3] == (3, None)
    for size in (1000, 7777, 10**9):  # ranges of any size give each page once
        text = paged.read_files(spark, f"file:{tmp_path}", "quire.sources.extract:FakeExtractor", "native", rangeBytes=size)
        assert text.rdd.getNumPartitions() == {1000: 102, 7777: 14, 10**9: 1}[size]
        got = {(os.path.basename(r["path"]), r["page"]): (r["text"], r["error"]) for r in text.collect()}
        assert len(got) == text.count() == 106 and got["a.pdf", 2] == ("two FIGURE", None) and got["c.pdf", 1] == (None, "broken page") and got["e.pdf", 77][0].startswith("page 77 ")
    image = paged.read_files(spark, str(tmp_path / "[ac].pdf"), FakeExtractor, "raster", dpi=72).where("error is null").select("image").collect()
    assert sorted(bytes(r["image"]) for r in image) == [b"72:last", b"72:one", b"72:three", b"72:two FIGURE"]
    assert paged.read_files(spark, str(tmp_path / "a.pdf"), FakeExtractor).count() == 3
    (tmp_path / "empty").mkdir()
    assert paged.read_files(spark, str(tmp_path / "empty"), FakeExtractor).count() == 0
    with pytest.raises(Exception, match="read is one of"):
        paged.PagedReader({"path": "x", "read": "all", "extractor": "quire.sources.extract:FakeExtractor"})


def test_ranges_share_partitions():
    assert paged.ranges([("a", 10), ("b", 30), ("c", 250), ("d", 1), ("e", 100)], 100) == [[("a", 0, 1), ("b", 0, 1)], [("c", 0, 3)], [("c", 1, 3)], [("c", 2, 3)], [("d", 0, 1)], [("e", 0, 1)]]


def test_file_sink(spark, tmp_path):
    out = tmp_path / "out"
    (tmp_path / "source.bin").write_bytes(b"copied" * 400_000)
    rows = [(f"p{i}/imgs/f.png", bytearray(f"content {i}".encode()), None) for i in range(40)] + [("copy.bin", None, f"file:{tmp_path}/source.bin")]
    df = spark.createDataFrame(rows, "name string, content binary, source string").repartition(5)
    assert filesink.write_files(df, str(out)) == 41
    assert sorted(os.listdir(out)) == sorted(["copy.bin", *(f"p{i}" for i in range(40))]) and (out / "p7/imgs/f.png").read_bytes() == b"content 7"
    assert (out / "copy.bin").read_bytes() == b"copied" * 400_000
    assert filesink.write_files(df.limit(0), str(out)) == 0
    for bad in ("../up", "/root/x", "a/../../b"):
        with pytest.raises(Exception, match="not a name below"):
            filesink.write_files(spark.createDataFrame([(bad, bytearray(b"x"))], "name string, content binary"), str(out))
    assert not (tmp_path / "up").exists()
    assert issubclass(filesink.FileWriter, DataSourceWriter)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    """One task of many fails half way through a copy: neither half files nor those of tasks that had ended stay."""
    out = tmp_path / "out"
    (tmp_path / "there.bin").write_bytes(b"x" * 100)
    rows = [(f"{i}.bin", f"file:{tmp_path}/there.bin" if i != 17 else f"file:{tmp_path}/nowhere.bin") for i in range(20)]
    df = spark.createDataFrame(rows, "name string, source string").repartitionByRange(20, "name")
    with pytest.raises(Exception, match="nowhere.bin"):
        filesink.write_files(df, str(out))
    left = [n for n in os.listdir(out) if not n.startswith(".")] if out.exists() else []
    assert all((out / n).read_bytes() == b"x" * 100 for n in left) and not [n for n in os.listdir(out) if n.startswith(".job")]


def test_writers_commit_and_abort(tmp_path):
    from pyspark.sql import Row

    writer = filesink.FileWriter(str(tmp_path), ["name", "content"])
    done = writer.write(iter([Row(name="a/b.txt", content=b"1"), Row(name="c.txt", content=b"2")]))
    assert done.names == 2 and (tmp_path / "a/b.txt").read_bytes() == b"1"
    writer.abort([done, None])
    assert not (tmp_path / "a/b.txt").exists() and not (tmp_path / "c.txt").exists() and os.listdir(tmp_path) == ["a"]
    writer = filesink.FileWriter(str(tmp_path), ["name", "content"])
    writer.commit([writer.write(iter([Row(name="c.txt", content=b"2")]))])
    assert sorted(os.listdir(tmp_path)) == ["a", "c.txt"]
    with pytest.raises(ValueError):
        filesink.FileWriter(str(tmp_path), ["name"])


WORDS = "plain words of a page that has many of them, more than twenty in all, so that " * 2


def command(tmp_path, source, out, *more):
    return cli.main(["--images", str(tmp_path / source), "--out", str(out), "--extractor", "quire.sources.extract:FakeExtractor", "--report", f"{out}.report", "--log", str(out.parent / "l"), "--keep-html", *more])


def test_figures_are_written(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.pdf").write_text("\f".join([f"{WORDS} FIGURE", WORDS, f"{WORDS} UNCUT", f"{WORDS} FIGURE"]))
    monkeypatch.chdir(tmp_path)
    assert command(tmp_path, "in", tmp_path / "out" / "b.md", "--method", "text") == 0
    found = {os.path.relpath(os.path.join(d, f), "output/figures"): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk("output/figures") for f in names}
    assert found == {"b_p001/imgs/figure_0.png": b"png of page 1", "b_p004/imgs/figure_0.png": b"png of page 4"}  # a tag without its file is a warning only
    assert open(tmp_path / "out" / "b.md").read().count('<img src="imgs/figure_0.png" />') == 3


def test_docling_is_a_method_where_the_extractor_has_it(spark, tmp_path):
    rows = listed(spark, put(tmp_path, a__pdf=f"{WORDS}\f{WORDS}").values())
    for make, head in ((FakeExtractor, "## converted"), (functools.partial(FakeExtractor), "plain words")):  # a partial names no methods
        parts = str(tmp_path / head[:2] / "parts")
        runs.run(spark, Config(extraction_method="docling"), rows, make, parts)
        assert {r["clean_text"][: len(head)] for r in files.read_parts(spark, parts).collect()} == {head}


def test_a_book_of_each_pdf(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("b10", "b9", "c"):
        (tmp_path / "in" / f"{name}.pdf").write_text(f"{name} one\f{name} two")
    out = tmp_path / "out" / "book.md"
    for taken in ("book-c.md", "book-c_1.md", "book-b9_7.md"):
        out.parent.mkdir(exist_ok=True)
        (out.parent / taken).write_text("mine")
    assert command(tmp_path, "in", out) == 0
    assert sorted(n for n in os.listdir(out.parent) if n.endswith(".md")) == ["book-b10.md", "book-b9.md", "book-b9_7.md", "book-c.md", "book-c_1.md", "book-c_2.md"]
    head = "# OCR Book\n\n<!-- Generated with paddleocrvl -->\n"
    page = lambda name, i, text: f"\n\n<!-- Page {name}_p00{i} -->\n\n{name} {text}\n"
    assert (out.parent / "book-c_2.md").read_text() == head + page("c", 1, "one") + page("c", 2, "two") and (out.parent / "book-c.md").read_text() == "mine"
    report = open(f"{out}.report").read()
    assert "| Processed successfully | 6 |" in report and "book-b10.md, book-b9.md, book-c_2.md" in report
    assert command(tmp_path, "in", tmp_path / "one" / "book.md", "--unify") == 0
    assert (tmp_path / "one" / "book.md").read_text() == head + "".join(page(n, i, t) for n in ("b9", "b10", "c") for i, t in ((1, "one"), (2, "two")))


def test_sources_of_one_name_keep_their_texts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.jpg", "a.png", "b.png"):
        (tmp_path / "in" / name).write_text(f"text of {name}")
    out = tmp_path / "out" / "book.md"
    for k, skipped in ((0, 0), (1, 3)):
        assert command(tmp_path, "in", out) == 0
        book = (out.parent / ("book.md" if not k else "book_1.md")).read_text()
        assert [book.count(f"text of {n}") for n in ("a.jpg", "a.png", "b.png")] == [1, 1, 1] and book.index("a.jpg") < book.index("a.png") < book.index("b.png")
        report = open(f"{out}.report").read()
        assert "| Total pages | 3 |" in report and f"| Processed successfully | {3 - skipped} |" in report and f"| Skipped (resume) | {skipped} |" in report
        assert report.count("| a | ") == (2 if not k else 0)
    assert sorted(os.listdir(out.parent)) == ["book.md", "book.md.report", "book_1.md", "l", "parts", "parts-raw"] and os.listdir(out.parent / "parts-raw") == []


def test_parts_of_two_runs_at_once(spark, tmp_path):
    """Both claim a number of their own, even if one has been claimed by a run that came to nothing."""
    df = spark.createDataFrame([("d", "p", 1, "x", "ok")], "doc_id string, page_id string, ord int, block string, status string")
    folder = str(tmp_path / "parts")
    assert files.write_parts(df, folder).endswith("batch=000000000000")
    open(f"{folder}/_claimed-000000000001", "w").close()
    assert files.write_parts(df.withColumn("block", F.lit("y")), folder).endswith("batch=000000000002")
    assert [r["block"] for r in files.read_parts(spark, folder).collect()] == ["y"] and not [n for n in os.listdir(folder) if n.startswith("_aside")]


def test_free_names(spark):
    wanted = spark.createDataFrame([("a", ".md"), ("a_1", ".md"), ("b", ".md"), ("c_2", ".md")], "stem string, ext string")
    taken = spark.createDataFrame([("a.md",), ("a_3.md",), ("b_1.md",), ("c_2.md",), ("c_2.txt",), ("d.md",), ("noext",)], "name string")
    assert sorted((r["stem"], r["name"]) for r in files.free_names(wanted, taken).collect()) == [("a", "a_2.md"), ("a_1", "a_1.md"), ("b", "b.md"), ("c_2", "c_2_1.md")]


def test_any_failure_is_an_exit_code(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jpg").write_text("x")
    assert cli.main(["--images", str(tmp_path / "in"), "--extractor", "nowhere.at.all:Thing", "--log", str(tmp_path / "l")]) == 1
    assert "the run failed" in open(tmp_path / "l").read()
