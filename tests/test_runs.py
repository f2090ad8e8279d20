"""Sources, runs, sinks and streams on files of their own."""

import io
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quire import config
from quire.config import Config, parse_bool, parse_int
from quire.operators import figures, order, pages, stats
from quire.plans import cli, runs
from quire.sources import epub, extract, files
from quire.streaming import ingest

EXT = (".jpg", ".jpeg", ".png", ".webp")


def make(tmp_path, names, start=1_700_000_000):
    for i, name in enumerate(names):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(f"text of {name}".encode())
        os.utime(path, (start + i, start + i))
    return str(tmp_path)


def test_collect_sources(spark, tmp_path):
    folder = make(tmp_path, ["page_10.jpg", "page_2.JPG", "page_1.jpg", "readme.txt", "b.PDF", "sub/x.png"])
    found = files.collect_sources(spark, folder, EXT).orderBy("ord").collect()
    assert [(r["name"], r["kind"], r["ord"]) for r in found] == [("b.PDF", "pdf", 0), ("page_1.jpg", "image", 1), ("page_2.JPG", "image", 2), ("page_10.jpg", "image", 3)]
    assert [r["name"] for r in files.collect_sources(spark, folder, EXT, (f"{folder}/sub/x.png", f"{folder}/page_1.jpg")).orderBy("ord").collect()] == ["x.png", "page_1.jpg"]
    assert {r["kind"]: r["problem"] for r in order.kind_gate(files.collect_sources(spark, folder, EXT)).collect()} == {"pdf": "mixed kinds", "image": "mixed kinds"}
    only = make(tmp_path / "nested", ["c1/a.png"])
    with pytest.raises(files.SourceError, match="subfolders"):
        files.collect_sources(spark, only, EXT)


def test_rename_and_copy(spark, tmp_path):
    folder = make(tmp_path / "r", ["DSC002.jpg", "DSC001.PNG", "DSC003.jpg"])
    new = files.apply_plan(files.rename_plan(spark, folder, EXT, "img", 5), folder, move=True)
    assert [os.path.basename(x) for x in new] == ["img_005.jpg", "img_006.png", "img_007.jpg"] and sorted(os.listdir(folder)) == [os.path.basename(x) for x in new]
    folder = make(tmp_path / "c", ["b10/deep/z.jpg", "b10/own.jpg", "b2/a.jpg", "skip/n.txt"])
    plain = [os.path.relpath(files.local(r["old"]), folder).replace("../", "") for r in files.subfolder_plan(spark, folder, EXT).orderBy("ord").collect()]
    assert [p.split("c/")[-1].removeprefix(str(tmp_path)) for p in plain] == ["b2/a.jpg", "b10/deep/z.jpg", "b10/own.jpg"]
    level = [r["old"] for r in files.subfolder_plan(spark, folder, EXT, ["b10", "nowhere"], by_level=True).orderBy("ord").collect()]
    assert [os.path.basename(p) for p in level] == ["own.jpg", "z.jpg"]
    copied = files.apply_plan(files.subfolder_plan(spark, folder, EXT), folder)
    assert len(copied) == 3 and all(os.path.exists(p) for p in copied)


def test_never_overwrite(tmp_path):
    path = str(tmp_path / "book.md")
    assert [os.path.basename(files.write_book(t, path)) for t in "abc"] == ["book.md", "book_1.md", "book_2.md"]
    assert open(path).read() == "a"


def sources(spark, folder, texts):
    folder.mkdir(parents=True, exist_ok=True)
    rows = []
    for i, (n, t) in enumerate(texts.items()):
        path = folder / (f"{n}.pdf" if "\f" in t else f"{n}.jpg")
        path.write_text(t)
        rows.append(("book", f"file:{path}", n, path.suffix[1:].replace("jpg", "image"), i))
    return spark.createDataFrame(rows, "doc_id string, path string, stem string, kind string, ord int")


def test_run_and_resume(spark, tmp_path):
    config = Config(keep_html=True)
    rows = sources(spark, tmp_path / "s", {"a": "12\ncondi-\ntion", "b": "BROKEN", "c": "slow TIMEOUT page", "d": ""})
    parts = str(tmp_path / "parts")
    metrics = {r["name"]: r for r in runs.recognise(spark, config, rows, extract.FakeExtractor, parts).collect()}
    assert {n: (r["error"], r["no_layout"]) for n, r in metrics.items()} == {"a": (False, False), "b": (True, False), "c": (False, True), "d": (True, False)}
    more = sources(spark, tmp_path / "t", {"a": "changed", "e": "new page"})
    assert [r["name"] for r in runs.recognise(spark, config, more, extract.FakeExtractor, parts).collect()] == ["e"]
    kept = files.read_parts(spark, parts)
    assert sorted((r["page_id"], r["status"]) for r in kept.collect()) == [("a", "ok"), ("b", "error"), ("c", "fallback"), ("d", "error"), ("e", "ok")]
    order_ = spark.createDataFrame([("book", p, i) for i, p in enumerate("cabdex")], "doc_id string, page_id string, ord int")
    book = runs.books(spark, config, order_, parts).first()
    assert book["markdown"].startswith("# OCR Book\n\n<!-- Generated with paddleocrvl -->\n")
    assert [book["markdown"].index(f"Page {p}") for p in "cabde"] == sorted(book["markdown"].index(f"Page {p}") for p in "cabde")
    assert "<!-- Page a (p. 12) -->\n\ncondition\n" in book["markdown"] and "<!-- Page b — ERROR: broken page -->" in book["markdown"]
    assert (book["n_pages"], book["n_errors"]) == (5, 2)


def test_pdf_pages(spark, tmp_path):
    rows = sources(spark, tmp_path, {"f": "one\ftwo\fthree"})
    raw = extract.extract_pages(extract.page_list(extract.file_pages(rows, extract.FakeExtractor)), extract.FakeExtractor)
    assert sorted((r["page_id"], r["ord"], r["raw_text"]) for r in raw.collect()) == [("f_p001", 1, "one"), ("f_p002", 2, "two"), ("f_p003", 3, "three")]
    assert sorted(r["page_label"] for r in pages.text_parts(raw).collect()) == ["1", "2", "3"]


def test_stats_and_report(spark):
    rows = [("p1", 0.0, 8.0, 1.0, 10.0, 1500, False, False, False), ("p2", 0.0, 4.0, 1.0, 6.0, 500, True, True, False), ("p3", None, None, None, None, None, None, None, True)]
    df = spark.createDataFrame([("d", *r, i) for i, r in enumerate(rows)], "doc_id string, name string, t_pre double, t_ocr double, t_post double, total double, chars long, looped boolean, no_layout boolean, error boolean, ord int")
    s = stats.with_eta(stats.run_stats(df), F.lit(6), F.lit(1)).first()
    assert (s["done"], s["errors"], s["loop_stops"], s["fallbacks"], s["total_chars"], s["avg_chars"], s["avg_time"], s["eta_s"]) == (2, 1, 1, 1, 2000, 1000, 8.0, 16.0)
    empty = stats.with_eta(stats.run_stats(df.limit(0)), F.lit(6), F.lit(1)).first()
    assert (empty["done"], empty["avg_time"], empty["eta_s"]) == (0, 0.0, None)
    lines = [r["line"] for r in stats.report(df, total=4, skipped=1, title="OCR Run Report", facts={"Model": "m"}, load_s=1.25, elapsed_s=90).orderBy("part", "ord").collect()]
    text = "\n".join(lines)
    assert "| Total pages | 4 |" in text and "| Skipped (resume) | 1 |" in text and "| Errors | 1 |" in text and "| Total duration (pipeline) | 1.5 min |" in text
    assert "| Inference (pipeline.predict) | 6.00s | 4.00s | 8.00s | 12.0s | 75.0% |" in text and "- p2" in text
    assert "| p1 | 8.00s | 1.000s | 10.00s | 1,500 |  |" in text and "| p3 | — | — | — | ERROR |  |" in text


def archive(images=True):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", '<package xmlns="x"><manifest><item href="b.xhtml" media-type="application/xhtml+xml"/><item href="a.xhtml" media-type="application/xhtml+xml"/><item href="bad.xhtml" media-type="application/xhtml+xml"/></manifest></package>')
        z.writestr("O/b.xhtml", "<html><body><h1>Head</h1><p>One <b>two</b> three</p><div></div></body></html>")
        z.writestr("O/a.xhtml", "<html><body><p>Last  one</p></body></html>")
        z.writestr("O/bad.xhtml", "<p>not closed")
        if images:
            for name in ("O/i/x.png", "O/j/x.png", "O/j/y.GIF", "O/t.css"):
                z.writestr(name, name)
    return out.getvalue()


def test_epub(spark):
    books = spark.createDataFrame([("d", bytearray(archive())), ("e", bytearray(archive(False)))], "doc_id string, content binary")
    found = {r["path"]: r["saved"] for r in epub.images(books).collect()}
    assert found == {"O/i/x.png": "x.png", "O/j/x.png": "x_1.png", "O/j/y.GIF": "y.GIF"}
    text = {r["doc_id"]: (r["markdown"], r["items"]) for r in epub.texts(books).collect()}
    assert text["d"] == text["e"] == ("Head \n One two three\n\nLast one", 3)
    done = {r["doc_id"]: r for r in runs.epub_books(books).collect()}
    assert done["d"]["metrics"]["images"] == 3 and done["e"]["metrics"]["images"] == 0 and done["d"]["markdown"].startswith("Head\n")
    raw = spark.createDataFrame([("d", "![a](O/j/x.png) <svg>\n</svg>")], "doc_id string, markdown string")
    clean = epub.clean_books(raw, epub.images(books))
    assert clean.first()["markdown"] == "![a](figures/x_1.png)\n\n![](figures/inline_svg_001.svg)"
    assert [(r["name"], r["content"]) for r in epub.svg_files(clean).collect()] == [("inline_svg_001.svg", "<svg>\n</svg>")]


def test_names_that_clash_with_numbered_ones(spark):
    names = ["x.png", "x.png", "x_1.png", "x.png", "x_1.png", ".png", ".png"]
    rows = spark.createDataFrame([(d, f"{i}/{n}", n, 10 - i) for d in "de" for i, n in enumerate(names)], "doc_id string, path string, name string, ord int")
    by_path = figures.collision_names(rows.drop("ord")).where("doc_id = 'd'").orderBy("path").collect()
    assert [r["saved"] for r in by_path] == ["x.png", "x_1.png", "x_1_1.png", "x_2.png", "x_1_2.png", ".png", ".png_1"]
    by_place = figures.collision_names(rows).where("doc_id = 'e'").orderBy("ord").collect()
    assert [r["saved"] for r in by_place] == [".png", ".png_1", "x_1.png", "x.png", "x_1_1.png", "x_2.png", "x_3.png"]


def test_figures(spark, tmp_path):
    root = make(tmp_path, ["out/p1/imgs/a.png", "out/p2/imgs/a.png", "out/p2/imgs/b.png", "out/p3/imgs/c.png", "vault/F/c.png"])
    config = Config(figures_dir=f"{root}/out", vault_root=f"{root}/vault", vault_figures_dir="F")
    assert runs.migrate(spark, config, dry_run=True) == 3
    only = spark.createDataFrame([("p1",)], "page_id string")
    assert runs.migrate(spark, config, page_ids=only) == 1
    assert runs.migrate(spark, config) == 1 and sorted(os.listdir(f"{root}/vault/F")) == ["a.png", "b.png", "c.png"]
    assert runs.migrate(spark, config) == 0
    with pytest.raises(ValueError):
        runs.migrate(spark, Config())
    row = spark.range(1).select(figures.text_blocks(F.array(F.lit("text"), F.lit("footer"))), figures.crop_points(F.array(F.lit(200.0)))).first()
    assert list(row) == [["text"], [72.0]]


def test_sampling(spark):
    got = [r[0] for r in spark.createDataFrame([(0,), (3,), (5,), (6,), (100,)], "n int").select(extract.sample_pages(F.col("n"))).collect()]
    assert got == [[], [0, 1, 2], [0, 1, 2, 3, 4], [0, 1, 2, 3, 5], [0, 24, 49, 74, 99]]


def test_stream(spark, tmp_path):
    schema = extract.PAGES_RAW
    rows = lambda k: spark.createDataFrame([("d", f"p{i}", i, "s", "m", f"condi-\ntion {i}", 0.5, None, False) for i in range(k, k + 5)], schema)
    rows(0).write.parquet(str(tmp_path / "in"))
    args = (Config(keep_html=True), str(tmp_path / "parts"), str(tmp_path / "state"))
    ingest.write_parts(ingest.page_stream(spark, str(tmp_path / "in")), *args).awaitTermination()
    rows(3).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.write_parts(ingest.page_stream(spark, str(tmp_path / "in")), *args).awaitTermination()
    found = files.read_parts(spark, args[1]).collect()
    assert sorted(r["page_id"] for r in found) == [f"p{i}" for i in range(8)] and all("condition" in r["clean_text"] for r in found)
    again = files.read_parts(spark, args[1]).orderBy("page_id").collect()
    files.write_parts(files.read_parts(spark, args[1]).where("page_id = 'p1'").selectExpr("* except (status)", "'mended' as status"), args[1])
    assert {r["page_id"]: r["status"] for r in files.read_parts(spark, args[1]).collect()} == {r["page_id"]: "mended" if r["page_id"] == "p1" else r["status"] for r in again}
    files.write_parts(spark.read.parquet(f"{args[1]}/batch=000000000000").where("page_id = 'p2'"), args[1], 1)  # a batch that comes again replaces its own
    assert files.read_parts(spark, args[1]).count() == 5
    before = sorted(map(str, files.read_parts(spark, args[1]).collect()))
    files.compact_parts(spark, args[1])
    assert sorted(map(str, files.read_parts(spark, args[1]).collect())) == before and len(os.listdir(args[1])) == 1
    running = ingest.progress(ingest.page_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("progress_test").outputMode("complete").trigger(availableNow=True).start()
    running.awaitTermination()
    assert spark.table("progress_test").first()["done"] == 10


def test_config_and_cli(spark, tmp_path):
    with pytest.raises(ValueError):
        Config(n_parallel=0)
    assert [parse_bool(x) for x in (None, " ", "Yes", "0")] == [None, None, True, False] and parse_int("", 3) == 3 and parse_int("7") == 7
    with pytest.raises(ValueError):
        parse_bool("maybe")
    args = cli.parser().parse_args(["--header-pattern", "^A", "1", "--header-pattern", "^B", "2", "--no-resume", "--rename-only"])
    assert cli.to_config(args).header_patterns == (("^A", 1), ("^B", 2)) and not cli.to_config(args).resume and args.rename_only == 1
    assert config.from_environment({"OCR_PAGE_TIMEOUT": "7", "OCR_OBSIDIAN_VAULT_ROOT": "/v", "OCR_N_PARALLEL": " "}) == {"page_timeout": 7, "vault_root": "/v"}
    folder = make(tmp_path / "in", ["a.jpg", "b.jpg"])
    out, more = str(tmp_path / "out" / "book.md"), ["--report", str(tmp_path / "r.md"), "--log", str(tmp_path / "run.log")]
    assert cli.main(["--images", folder, "--out", out, *more]) == 1  # no extractor is named
    assert cli.main(["--images", str(tmp_path / "nowhere"), "--out", out, *more]) == 1
    assert "no such" not in open(tmp_path / "run.log").read() and "not found" in open(tmp_path / "run.log").read()
    more += ["--extractor", "quire.sources.extract:FakeExtractor"]
    assert cli.main(["--images", folder, "--out", out, *more]) == 0
    assert open(out).read() == "# OCR Book\n\n<!-- Generated with paddleocrvl -->\n" + "".join(f"\n\n<!-- Page {x} -->\n\ntext of {x}.jpg\n" for x in "ab")
    report = open(tmp_path / "r.md").read()
    assert report.startswith("# OCR Run Report\n\n**Date** : ") and "| Total pages | 2 |" in report and "| Processed successfully | 2 |" in report and "| Skipped (resume) | 0 |" in report
    (tmp_path / "in" / "c.jpg").write_text("BROKEN")
    assert cli.main(["--images", folder, "--out", out, *more]) == 2
    assert open(str(tmp_path / "out" / "book_1.md")).read() == open(out).read() + "\n\n<!-- Page c — ERROR: broken page -->\n"
    assert "| Skipped (resume) | 2 |" in open(tmp_path / "r.md").read()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "c.jpg").write_text("BROKEN")
    assert cli.main(["--images", str(tmp_path / "bad"), "--out", str(tmp_path / "none" / "book.md"), *more, "--log", str(tmp_path / "bad" / "run.log")]) == 2
    assert not os.path.exists(tmp_path / "none" / "book.md")


def test_vault_on_the_command_line(spark, tmp_path):
    root = make(tmp_path, ["in/a.jpg", "figures/a/imgs/q.png", "figures/z/imgs/z.png"])
    (tmp_path / "in" / "a.jpg").write_text('x- y <img src="imgs/q.png">')
    own = ["--mode", "obsidian", "--vault-root", f"{root}/vault", "--vault-path", "Notes", "--vault-figures-dir", "F", "--out", f"{root}/book.md", "--report", f"{root}/r.md", "--log", f"{root}/l"]
    assert cli.main(["--mode", "obsidian", "--postprocess-only", "--log", f"{root}/l"]) == 1  # no vault
    assert cli.main(["--postprocess-only", "--log", f"{root}/l"]) == 1
    here = os.getcwd()
    os.chdir(root)
    try:
        os.makedirs("output")
        os.rename("figures", "output/figures")
        assert cli.main([*own, "--images", f"{root}/in", "--keep-html", "--extractor", "quire.sources.extract:FakeExtractor"]) == 0
        assert open(f"{root}/vault/Notes/book.md").read().endswith("\n\nxy ![[F/q.png]]\n") and os.listdir(f"{root}/vault/F") == ["q.png"]  # the run's pages alone
        with open(f"{root}/vault/Notes/book.md", "w") as f:
            f.write('x- y <img src="f/imgs/q.png">')
        assert cli.main([*own, "--postprocess-only"]) == 0
        assert open(f"{root}/vault/Notes/book.md").read() == "xy ![[F/q.png]]" and sorted(os.listdir(f"{root}/vault/F")) == ["q.png", "z.png"]
    finally:
        os.chdir(here)


def test_epub_on_the_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.epub").write_bytes(archive())
    here, more = os.getcwd(), ["--log", str(tmp_path / "l")]
    os.chdir(tmp_path)
    try:
        for source in ("in", "in/b.epub"):
            os.makedirs("output/figures", exist_ok=True)
            open("output/figures/old.png", "w").close()
            assert cli.main(["--images", str(tmp_path / source), "--out", "output/b.md", *more]) == 0
            assert open("output/b.md").read() == "Head\n One two three\n\nLast one" and sorted(os.listdir("output/figures")) == ["x.png", "x_1.png", "y.GIF"]
        vault = ["--mode", "obsidian", "--vault-root", str(tmp_path / "v"), "--vault-path", "N", "--vault-figures-dir", "F"]
        assert cli.main(["--images", str(tmp_path / "in"), "--out", "output/b.md", *vault, *more]) == 0
        assert os.listdir("v/N") == ["b.md"] and len(os.listdir("v/F")) == 3
        (tmp_path / "in" / "c.epub").write_bytes(archive())
        assert cli.main(["--images", str(tmp_path / "in"), "--out", "output/b.md", *more]) == 1  # two of them
    finally:
        os.chdir(here)


def test_text_pdfs_on_the_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    words = "\f".join([f"{i}\n" + "plain words of a page that has many of them, more than twenty in all, so that " * 2 + ("FIGURE" if i == 2 else "") for i in range(1, 8)] + ["BROKEN"])
    for kind, text in (("text", words), ("image", "few\fwords")):
        (tmp_path / kind).mkdir()
        (tmp_path / kind / "b.pdf").write_text(text)
        more = ["--method", "text", "--extractor", "quire.sources.extract:FakeExtractor", "--report", str(tmp_path / "r.md"), "--log", str(tmp_path / kind / "out" / "l")]
        assert cli.main(["--images", str(tmp_path / kind), "--out", str(tmp_path / kind / "out" / "b.md"), *more]) == (2 if kind == "text" else 0)
    book = open(tmp_path / "text" / "out" / "b.md").read()
    line = "plain words of a page that has many of them, more than twenty in all, so that " * 2
    blocks = [f"\n\n<!-- Page b_p{i:03d} (p. {i}) -->\n\n{line}" + ('FIGURE\n\n<img src="imgs/figure_0.png" />' if i == 2 else "") + "\n" for i in range(1, 8)]
    assert book == "# OCR Book\n\n<!-- Generated with text -->\n" + "".join(blocks) + "\n\n<!-- Page b_p008 — ERROR: broken page -->\n"
    assert "\n\n<!-- Page b_p001 -->\n\nfew\n" in open(tmp_path / "image" / "out" / "b.md").read()  # recognised, so no place for a label


def test_rename_on_the_command_line(spark, tmp_path):
    folder, more = make(tmp_path / "s", ["own.jpg", "c2/a.jpg", "c1/b.jpg"]), ["--log", str(tmp_path / "l"), "--rename-only"]
    assert cli.main(["--images", folder, *more, "0"]) == 0  # subfolders beside own images: these are copied
    assert sorted(x for x in os.listdir(folder) if x.endswith(".jpg")) == ["own.jpg", "page_000.jpg", "page_001.jpg"] and open(f"{folder}/page_000.jpg").read() == "text of c1/b.jpg"
    folder = make(tmp_path / "t", ["c2/a.jpg", "c1/b.jpg"])
    assert cli.main(["--images", folder, *more, "5", "--chapters", "c2"]) == 0
    assert open(f"{folder}/page_005.jpg").read() == "text of c2/a.jpg"
    folder = make(tmp_path / "u", ["b.jpg", "page_001.jpg", "page_002.jpg"])  # each name but one is another file's before
    assert cli.main(["--images", folder, *more]) == 0
    assert [open(f"{folder}/page_00{i}.jpg").read() for i in (1, 2, 3)] == ["text of b.jpg", "text of page_001.jpg", "text of page_002.jpg"]


def test_lists_and_timeouts(spark, tmp_path):
    folder = make(tmp_path, ["b.jpg", "a.png", "a.jpg", "n.txt"])
    assert [r["name"] for r in files.collect_sources(spark, folder, EXT, documents=False).orderBy("ord").collect()] == ["a.jpg", "a.png", "b.jpg"]
    for bad in (f"{folder}/gone", f"{folder}/n.txt"):
        with pytest.raises(files.SourceError):
            files.collect_sources(spark, bad, EXT, documents=False)
    with pytest.raises(files.SourceError, match="not found"):
        files.collect_sources(spark, folder, EXT, (f"{folder}/a.jpg", f"{folder}/gone.jpg"))
