"""Trees on disk, reports on disk."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from corpusmill import settings
from corpusmill.operators import filters, ledger
from corpusmill.plans import analysis, reduction, report
from corpusmill.sources import files, report_text, sinks, tables


@pytest.fixture
def tree_root(tmp_path):
    content = {
        "README.md": b"# Demo\nA small tree.\n",
        "docs/about the+thing%20.txt": "Grüße\r\nzwei\n".encode(),
        "pkg/__init__.py": b"",
        "pkg/.settings/x.py": b"ignored",
        "_private/.hidden/deep.py": b"z = 1",
        "src/one.py": b"# note\ndef f():\n    return 1\n",
        "src/deep/two.txt": b"plain",
        "src/bad.dat": b"\xff\xfe\x00\x01",
        "node_modules/x/y.js": b"ignored",
        "logo.png": b"ignored",
        "src/LICENSE": b"ignored",
        ".gitignore": b"*.tmp\n",
        "a.tmp": b"by rule",
    }
    for name, data in content.items():
        path = tmp_path / "demo" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(tmp_path / "demo")


def _scan(spark, root, **options):
    return {r.path: r.content for r in files.scan_tree(spark, root, **options).collect()}


def test_scan(spark, tree_root):
    assert _scan(spark, tree_root) == {
        "README.md": "# Demo\nA small tree.\n",
        ".gitignore": "*.tmp\n",
        "a.tmp": "by rule",
        "docs/about the+thing%20.txt": "Grüße\nzwei\n",
        "pkg/__init__.py": "",
        "_private/.hidden/deep.py": "z = 1",
        "src/one.py": "# note\ndef f():\n    return 1\n",
        "src/deep/two.txt": "plain",
        "src/bad.dat": settings.BINARY_PLACEHOLDER,
    }
    raw = _scan(spark, tree_root, normalise_newlines=False, keep_readme=False, skip=["deep", "a.tmp"])
    assert set(raw) == {"docs/about the+thing%20.txt", "pkg/__init__.py", "_private/.hidden/deep.py", "src/one.py", "src/bad.dat"}
    assert raw["docs/about the+thing%20.txt"] == "Grüße\r\nzwei\n"


def test_roots(spark, tree_root):
    base, name = os.path.split(tree_root)
    corpus, roots = files.scan_roots(spark, base, [name, "missing"])
    assert corpus.where("repo = 'demo'").count() == 9
    assert [(r.repo, r.root_no, r.error) for r in roots.orderBy("root_no").collect()] == [
        ("demo", 1, None), ("missing", 2, "not a valid directory"),
    ]
    none, _ = files.scan_roots(spark, base, ["missing"])
    assert none.count() == 0


def test_unreadable_files_and_links(spark, tree_root):
    """A file that cannot be opened is a row; a link to a directory is not followed."""
    os.symlink(os.path.join(tree_root, "nowhere"), os.path.join(tree_root, "src", "gone.py"))
    os.symlink(tree_root, os.path.join(tree_root, "src", "again"))
    found = _scan(spark, tree_root)
    assert found["src/gone.py"].startswith("Error reading file: ") and len(found) == 10
    with pytest.raises(NotADirectoryError):
        files.scan_tree(spark, os.path.join(tree_root, "src", "one.py"))


def test_one_top_folder_uses_many_tasks(spark, tmp_path):
    """Files of one folder are dealt over tasks; many roots are one corpus, numbered by root and path."""
    for root in ("a", "b", "c"):
        for i in range(40):
            path = tmp_path / root / "top" / f"d{i % 4}" / f"f{i:02d}.py"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(f"{root} {i}")
    corpus, roots = files.scan_roots(spark, str(tmp_path), ["b", "a", "missing", "c"], skip=["d3"])
    rows = corpus.orderBy("ord").collect()
    assert [(r.repo, r.path) for r in rows] == [(x, f"top/d{d}/f{i:02d}.py") for x in "bac" for d in range(3) for i in range(d, 40, 4)]
    assert all(r.content == f"{r.repo} {int(r.path[-5:-3])}" for r in rows)
    assert corpus.select(F.spark_partition_id()).distinct().count() > 8
    assert [(r.repo, r.error) for r in roots.orderBy("root_no").collect()] == [("b", None), ("a", None), ("missing", "not a valid directory"), ("c", None)]


def test_fetched_files(spark):
    raw = spark.createDataFrame(
        [
            ("r", "a.txt", 0, bytearray("é".encode()), "base64"),
            ("r", "b.txt", 1, bytearray(b"\xe9"), "base64"),
            ("r", "c.txt", 2, bytearray(b"x"), None),
            ("r", "d.txt", 3, bytearray(b"x"), "none"),
            ("r", "e.PNG", 4, bytearray(b"x"), "base64"),
        ],
        "repo string, path string, ord bigint, content binary, encoding string",
    )
    assert [r.content for r in tables.corpus_from_fetched(raw).orderBy("ord").collect()] == [
        "é", "é", settings.MISSING_ENCODING_PLACEHOLDER, settings.MISSING_ENCODING_PLACEHOLDER,
        settings.BINARY_BY_SUFFIX_PLACEHOLDER,
    ]


def _written(location):
    """Text of each report folder, its parts in the order of their names."""
    out = {}
    for folder in glob.glob(f"{location}/report=*"):
        parts = sorted(glob.glob(f"{folder}/part-*"))
        out[folder.rsplit("report=", 1)[1]] = "".join(open(p, encoding="utf-8", newline="").read() for p in parts)
    return out


def test_report_round_trip(spark, tree_root, tmp_path):
    corpus = files.scan_tree(spark, tree_root)
    rows, components = report.corpus_report(corpus, rules=filters.rules_of_files(corpus))
    location = str(tmp_path / "out")
    sinks.write_reports(rows, location)
    text = _written(location)["demo_analysis"]
    wanted = corpus.where("path NOT IN ('README.md', '.gitignore', 'a.tmp')").orderBy("ord").collect()
    assert text == (
        "README:\n# Demo\nA small tree.\n\n\n"
        "Structure:\ndemo/\n    _private/\n        .hidden/\n            deep.py\n    docs/\n        about the+thing%20.txt\n"
        "    pkg/\n        __init__.py\n    src/\n        bad.dat\n        one.py\n"
        "        deep/\n            two.txt\n\n"
        "File Contents:\n" + "".join(f"File: {w.path}\nContent:\n{w.content}\n\n" for w in wanted)
    )
    # The ledger adds up to the report, character by character.
    assert components.agg({"char_count": "sum"}).first()[0] == len(text)
    sections = {r.section: r.percent for r in ledger.section_budget(components).collect()}
    assert abs(sum(sections.values()) - 100) < 1e-9
    assert report.report_bytes(rows).first().n_bytes == len(text.encode())

    # Reading it back gives the files again, whole or split at the blocks.
    one_file = tmp_path / "demo_analysis.txt"
    one_file.write_text(text, encoding="utf-8")
    expected = {w.path: w.content.strip() for w in wanted}
    whole = report_text.report_blocks(report_text.report_sections(report_text.read_reports(spark, str(one_file))))
    assert {r.path: r.content for r in whole.collect()} == expected
    split = report_text.read_report_blocks(spark, str(one_file)).orderBy("ord").collect()
    assert [(r.repo, r.path, r.content) for r in split] == [("demo_analysis", p, c) for p, c in expected.items()]


def test_reduced_report(spark, corpus, tmp_path):
    from corpusmill.operators import tree

    level = settings.LEVELS["heavy"]
    source = corpus(("r", "README.md", "Hi\n\n"), ("r", "a.py", "x = 1"), ("s", "b.py", "y = 2"))
    wanted = filters.keep_wanted(source)
    readme = ledger.pick_readme(source.select("repo").distinct(), source)
    rows = report.reduced_report_rows(
        reduction.reduce_corpus(wanted, level), readme,
        analysis.repo_summary(wanted, analysis.file_stats(wanted), level), tree.tree_listing(wanted),
    )
    roots = spark.createDataFrame([("r", 1), ("s", 2)], "repo string, root_no bigint")
    location = str(tmp_path / "out")
    sinks.write_reports(rows, location, sinks.report_names(roots, "mine", "heavy"))
    written = _written(location)
    assert set(written) == {"mine_1_compressed_heavy", "mine_2_compressed_heavy"}
    assert written["mine_1_compressed_heavy"] == (
        "README:\nHi\n\nRepository Analysis Summary:\n"
        "Repository contains 1 files with approximately 1 lines of code.\nMain languages: python (1).\n"
        "Largest file: a.py (1 lines).\nKey files include:\n- a.py\n"
        "Note: Heavy compression applied - focusing on structure and key elements while aggressively summarizing details.\n\n"
        "Structure:r/\n    a.py\n\nFile Contents:\nFile: a.py\nContent:\nx = 1\n\n"
    )
    names = sinks.report_names(roots, level="heavy").orderBy("repo").collect()
    assert [n.report for n in names] == ["r_analysis_compressed_heavy", "s_analysis_compressed_heavy"]
    assert sinks.report_names(roots.limit(1), "one").first().report == "one"


def _whole_form(spark, texts, level):
    """Rows of the reduced reports from texts held whole, with files numbered in order."""
    reports = spark.createDataFrame(list(texts.items()), "repo string, text string")
    return reduction.reduce_reports(reports, level).select("repo", "section", "text", "ord")


@pytest.mark.parametrize("level", ["heavy"])
def test_report_files_over_many_splits(spark, tmp_path, level):
    """Reports in one file and in part files, cut into splits of a few hundred bytes, against their whole form."""
    rng = random.Random(21)
    body = lambda i: "\n".join(f"line {i} {k} {rng.choice(['shared text of some length, which repeats ' * 2, 'own'])}" for k in range(rng.randrange(60)))
    block = lambda i: f"File: src/f{i % 37}.{'py' if i % 2 else 'txt'}\nContent:\n{body(i)}\n\n"
    whole = "README:\n  About\n\nFile: not a block\n\nStructure:\nr/\n    src/\n\nFile: listed\n\nFile Contents:\n" + "".join(block(i) for i in range(45))
    parts = ["README:\nParts\n\nStructure:\np/\n", "    a/\n    b/\n\nFile Contents:\n" + block(1), block(2) + block(3) + "File: broken\nno content\n\n", block(1) + "File Contents: Structure: README:\n"]
    plain = {"no_sections.txt": "File: x\nContent:\ny\n\nFile: z\nContent:\n", "no_files.txt": "README: only\n\nFile: a", "whole.txt": whole, "empty_parts.txt": "README:\nStructure:\nFile Contents:"}
    folder = tmp_path / "reports"
    folder.mkdir()
    for name, content in plain.items():
        (folder / name).write_text(content)
    parted = tmp_path / "parted" / "report=many"
    parted.mkdir(parents=True)
    for i, content in enumerate(parts):
        (parted / f"part-{i:05d}.txt").write_text(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 8
        for path, texts in ((folder, {n.removesuffix(".txt"): t for n, t in plain.items()}), (tmp_path / "parted", {"many": "".join(parts)})):
            got = reduction.reduce_report_files(spark, str(path), settings.LEVELS[level]).collect()
            expected = _whole_form(spark, texts, settings.LEVELS[level]).collect()
            for repo in texts:
                mine = [r.text for r in sorted((r for r in got if r.repo == repo), key=lambda r: (r.section, r.ord))]
                theirs = [r.text for r in sorted((r for r in expected if r.repo == repo), key=lambda r: (r.section, r.ord))]
                assert "\n".join(mine) == "\n".join(theirs), repo
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_report_files_are_cut_once(spark, tmp_path):
    """Blocks and sections are cut and stored before the jobs that read them; the reports' text is not read again."""
    folder = tmp_path / "reports"
    folder.mkdir()
    (folder / "r.txt").write_text("README:\nr\n\nStructure:\nr/\n\nFile Contents:\n" + "".join(f"File: f{i}.txt\nContent:\nbody {i}\n\n" for i in range(3)))
    for level in ("medium", "heavy"):
        rows = reduction.reduce_report_files(spark, str(folder), settings.LEVELS[level])
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Content:(?:" not in plan
        assert "_metadata" not in plan and "] text" not in plan
        assert rows.where("section = 4").count() == 3 and rows.where("section = 0").first().text == "README:\nr\n"


def test_blocks_of_a_scanned_report(spark, tmp_path):
    """The first line that opens a file within a block counts, whatever stands before it; text without one is no file."""
    white = "\t\x0b\x0c\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"
    blocks = [
        "a.txt\nContent:\nx\n  y",
        "no content here",
        "mentioned\nFile: b.txt \nContent:\nFile: z\nContent:\nkept",
        "c.txt\r\nContent:\r\n\r\nlines\r\nends",
        "empty.txt\nContent:",
        f"white.txt{white}\nContent:{white}in{white}side{white}",
        "File: d.txt\nContent: same line",
        "a.txt\nContent:\nlast",
    ]
    path = tmp_path / "r.txt"
    path.write_text("README:\nStructure:\nFile Contents:" + "".join(f"\n\nFile: {b}" for b in blocks), newline="")
    found = report_text.read_report_blocks(spark, str(path)).orderBy("ord").collect()
    assert [(r.path, r.content) for r in found] == [
        ("a.txt", "last"), ("b.txt", "File: z\nContent:\nkept"), ("c.txt", "lines\r\nends"), ("empty.txt", ""),
        ("white.txt", f"in{white}side"), ("File: d.txt", "same line"),
    ]
