"""Joins, ranks and whole jobs against brute force on small corpora."""

import itertools
import os
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill import settings
from corpusmill.catalog import queries
from corpusmill.functions import text as text_functions
from corpusmill.operators import duplicates, filters, profile, ranking, reduce, references
from corpusmill.plans import analysis, reduction
from corpusmill.sources import report_text

MEDIUM, HEAVY = settings.LEVELS["medium"], settings.LEVELS["heavy"]


def _random_corpus(n=60, repos=("hot", "hot", "b"), seed=3):
    """Files that mention each other's stems, often with overlaps; one hot repository."""
    rng = random.Random(seed)
    stems = ["a", "ab", "util", "utils", "import x", "main", "é", "test_x", "index", "from q"]
    rows = []
    for i in range(n):
        stem = rng.choice(stems)
        lines = [
            rng.choice(["import ", "from ", "from '", "xfrom ", "import  ", "import from ", "import\t"])
            + rng.choice(stems) + rng.choice(["", "/x", "'", "ils", "\nimport "])
            for _ in range(rng.randint(0, 4))
        ]
        rows.append((rng.choice(repos), f"d{i}/{stem}{rng.choice(['.py', '.txt', ''])}", "\n".join(lines)))
    return rows


def test_reference_count_equals_all_pairs(corpus):
    rows = _random_corpus()
    expected = {}
    for (repo, path, _), (other_repo, other, content) in itertools.product(rows, rows):
        if repo == other_repo and path != other:
            stem = os.path.splitext(os.path.basename(path))[0]
            plain = f"import {stem}" in content or f"from {stem}" in content
            quoted = "import " in content and f"from '{stem}" in content
            expected[repo, path] = expected.get((repo, path), 0) + plain + quoted
    found = references.reference_count(corpus(*rows)).collect()
    assert {(r.repo, r.path): r.import_count for r in found} == {k: v for k, v in expected.items() if v}



def test_importance_order(spark):
    names = ["x/MAIN.py", "a.tsx", "app_config.py", "pop.txt", "test_pop.txt", "spec.md", "Test.md"]
    counts = [0, 0, 0, 6, 6, 5, 0]
    frame = spark.createDataFrame(list(zip(range(7), names, counts)), "i int, p string, n bigint")
    rows = frame.select("i", profile.importance(F.col("p"), F.col("n")).alias("s")).orderBy("i").collect()
    assert [r.s for r in rows] == [10, 8, 8, 7, 7, 3, 5]


def _sections_of(content):
    """Plain-Python sections, for comparison."""
    keyed = itertools.groupby(
        content.splitlines(), key=lambda line: not line.strip() or line.strip()[0] in "#*" or line.strip()[:2] in ("//", "/*")
    )
    return [s for delimiter, run in keyed if not delimiter and len(s := "\n".join(run)) > 50]


def _chunks_by_window(files):
    """The same sections as ``duplicates.chunks``, from a table of lines and a running delimiter count."""
    line = F.col("line")
    lines = files.select(
        "repo", "path", "ord", F.posexplode(text_functions.split_lines(F.col("content"))).alias("ln", "line")
    ).withColumn("is_delim", line.rlike(rf"^[{text_functions.SPACE}]*+(?:#|//|/\*|\*|\z)"))
    island = F.sum(F.col("is_delim").cast("int")).over(Window.partitionBy("repo", "path").orderBy("ln"))
    return (
        lines.withColumn("island", island)
        .where(~F.col("is_delim"))
        .groupBy("repo", "path", "ord", "island")
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda s: s["line"]), "\n"
            ).alias("chunk")
        )
        .where(F.length("chunk") > duplicates.MIN_CHARS)
    )


def _duplicate_corpus(n=40, seed=5):
    rng = random.Random(seed)
    blocks = [("word%d " % k) * rng.randint(5, 12) for k in range(6)]
    blocks += [blocks[0] + "\n" + blocks[1], "short", "x" * 51, "y" * 50]
    rows = []
    for i in range(n):
        parts = [rng.choice(blocks) for _ in range(rng.randint(0, 5))]
        text = "".join(p + rng.choice(["\n\n", "\n# c\n", "\n  // c\n", "\n * c\n\n"]) for p in parts)
        rows.append((rng.choice(["hot", "hot", "b"]), f"f{i}.txt", text))
    return rows


def test_sections_and_groups(corpus):
    rows = _duplicate_corpus()
    files = corpus(*rows)
    found = duplicates.chunk_texts(files).orderBy("ord", "chunk_ord").collect()
    assert [(r.repo, r.path, r.chunk) for r in found] == [
        (repo, path, s) for repo, path, content in rows for s in _sections_of(content)
    ]
    # The window form over a line table gives the same sections.
    by_window = _chunks_by_window(files).select("repo", "path", "chunk").collect()
    assert sorted(map(tuple, by_window)) == sorted((r.repo, r.path, r.chunk) for r in found)
    groups = {}
    for r in found:
        groups.setdefault((r.repo, r.chunk), []).append(r.path)
    repeated = duplicates.duplicate_sections(files).collect()
    assert sorted((r.repo, r.n_occ, r.first_path) for r in repeated) == sorted(
        (repo, len(paths), paths[0]) for (repo, _), paths in groups.items() if len(paths) > 1
    )


def test_duplicate_replacement(corpus):
    rows = _duplicate_corpus()
    for threshold in (2, 4):
        seen, order = {}, {}
        for repo, path, content in rows:
            for s in _sections_of(content):
                places = seen.setdefault((repo, s), [])
                places.append(path)
                if len(places) == 2:
                    order[repo, s] = len(order)
        expected = {(repo, path): content for repo, path, content in rows}
        for repo, s in sorted(order, key=order.get):
            places = seen[repo, s]
            if len(places) >= threshold:
                note = f"# DUPLICATE CODE: Same as in {places[0]}\n# {len(s.splitlines())} lines\n"
                for path in places[1:]:
                    expected[repo, path] = expected[repo, path].replace(s, note)
        files = corpus(*rows)
        content = F.col("content")
        replaced = files.join(duplicates.replacements(files, threshold), ["repo", "path"], "left").select(
            "repo", "path", duplicates.replace_duplicates(content, content, F.col("edits")).alias("content")
        )
        assert {(r.repo, r.path): r.content for r in replaced.collect()} == expected


def test_files_that_share_a_path_keep_their_own_sections(spark, corpus):
    one, two, three = (" ".join(["word%d" % k] * 10) for k in range(3))
    files = corpus(
        ("r", "main.py", one),
        ("r", "main.py", f"{two}\n\n{three}\n\n{one}"),
        ("r", "other.py", f"{three}\n\n{one}"),
    )
    told = "# DUPLICATE CODE: Same as in main.py\n# 1 lines\n"
    expected = [one, f"{two}\n\n{three}\n\n{told}", f"{told}\n\n{told}"]
    replaced = queries._duplicate_replace(files).collect()
    assert sorted((r.path, r.content) for r in replaced) == sorted(zip(["main.py", "main.py", "other.py"], expected))
    for level in (HEAVY, settings.LEVELS["heavy_all"]):
        reduced = reduction.reduce_corpus(files, level).orderBy("ord").collect()
        assert [r.ord for r in reduced] == [0, 1, 2]
        assert [r.content.count("DUPLICATE CODE") for r in reduced] == [0, 1, 2]
    # Rows that share all keys are told apart by what they hold.
    same_keys = spark.createDataFrame(
        [("r", "a.py", 1, three), ("r", "a.py", 1, f"{two}\n\n{one}"), ("r", "b.py", 2, one)],
        "repo string, path string, ord bigint, content string",
    )
    assert sorted(r.content for r in queries._duplicate_replace(same_keys).collect()) == sorted(
        [three, f"{two}\n\n{one}", "# DUPLICATE CODE: Same as in a.py\n# 1 lines\n"]
    )


def test_retention_and_ranks(corpus):
    rows = [("big", f"d/{i}.{'py' if i % 3 == 0 else 'txt'}", "x\n" * (i % 7)) for i in range(30)]
    rows += [("small", f"{i}.txt", "") for i in range(20)]
    stats = analysis.file_stats(corpus(*rows))
    kept = {(r.repo, r.path) for r in ranking.retained(stats).collect()}
    by_score = sorted(rows[:30], key=lambda row: not row[1].endswith("py"))[:15]
    assert kept == {(r[0], r[1]) for r in by_score} | {(r[0], r[1]) for r in rows[30:]}
    largest = ranking.largest_files(stats).where("repo = 'big'").orderBy("rn").collect()
    assert [r.path for r in largest] == [r[1] for r in sorted(rows[:30], key=lambda row: -len(row[2]))[:10]]


def test_skip_note_equals_reduction_of_the_list(corpus, apply):
    """The closed form is what reduction makes of the written-out list."""
    for n_files in (21, 320):
        rows = [("r", f"dir/file_{i}.txt", "") for i in range(n_files)]
        stats = analysis.file_stats(corpus(*rows))
        listed = ranking.skipped_summary(stats).orderBy("section", "ord").collect()
        assert len(listed) == n_files - 15 + 3
        whole = "\n".join(r.line for r in listed)
        path = F.lit(settings.SKIPPED_SUMMARY_PATH)
        assert apply(lambda t: reduce.reduce_content(path, F.lit(5), t, HEAVY), whole) == apply(
            lambda t: reduce.reduced_skip_note(F.length(t), path, HEAVY), "x" * (n_files - 15)
        )


def test_reduce_corpus(corpus):
    comment = "\n".join(f"# {i}" for i in range(6))
    shared = "shared words " * 6
    long_text = "\n".join(f"line {i}" for i in range(40))
    files = corpus(
        ("r", "a.py", f"x = 1\n{comment}\n{shared}"),
        ("r", "b.rb", f"y = 1\n{shared}"),
        ("r", "lib/test_c.py", "def f():\n    pass\n"),
        ("r", "spec.txt", long_text),
    )
    heavy = {r.path: r.content for r in reduction.reduce_corpus(files, HEAVY).collect()}
    assert heavy == {
        "a.py": f"x = 1\n# 0\n# ... 5 more comment lines ...\n{shared.strip()}",
        # The section was found with its final blank, which reduction took off.
        "b.rb": f"# Note: This file has been compressed for LLM analysis\n# Original file: b.rb\n\ny = 1\n{shared.strip()}",
        "lib/test_c.py": "# Test file summary: lib/test_c.py\n# 2 lines of testing code\n# Skipped in heavy compression mode",
        "spec.txt": "# File summary: spec.txt (40 lines, unknown)\n# This file was compressed due to lower relevance.\n\n"
        "# First few lines:\n" + "\n".join(f"line {i}" for i in range(10)) + "\n\n# ...",
    }
    medium = {r.path: r.content for r in reduction.reduce_corpus(files, MEDIUM).collect()}
    assert medium["a.py"] == f"x = 1\n{comment}\n{shared}"  # below the minimum size
    assert medium["spec.txt"] == long_text
    ratio = reduction.reduction_ratio(files.where("path = 'nothing'"), files.where("path = 'nothing'")).collect()
    assert ratio == []
    empty = reduction.reduction_ratio(corpus(("r", "e.py", "")), corpus(("r", "e.py", ""))).first()
    assert empty.percent is None


def test_reports_are_cut_once(spark):
    """Each report is read for its files and for the rest, not by every job that reads the files."""
    read = spark.sparkContext.accumulator(0)

    def count(text):
        read.add(1)
        return text

    block = "File: a.py\nContent:\nx = 1\r\n\r\n\nb\n\nFile: test_a.py\nContent:\n\ny\n\nFile: a.py\nContent:\nlast"
    rows = [(f"r{i}", f"README:\n{i}\n\nStructure:\nr/\n\nFile Contents:\n{block}\n\n") for i in range(10)]
    reports = spark.createDataFrame(rows, "repo string, text string").select("repo", F.udf(count)("text").alias("text"))
    reduced = reduction.reduce_reports(reports, HEAVY).where("repo = 'r3'").orderBy("section", "ord").collect()
    assert [r.text.split("\n")[0] for r in reduced] == [
        "README:", "Repository Analysis Summary:", "Structure:r/", "File Contents:", "File: a.py", "File: test_a.py",
    ]
    assert reduced[4].text == "File: a.py\nContent:\nlast\n"
    assert read.value <= 2 * len(rows)


def test_ignore_rules(spark, corpus):
    lines = ["*.log", "/build/", "docs/**/x?.md", "!keep.log", "*.py[co]", "a.b", "# c", "  "]
    rules = filters.parse_rules(spark.createDataFrame([("r", line) for line in lines], "repo string, line string"))
    paths = ["a.log", "d/a.log", "keep.log", "build/z/q.c", "src/build/q.c", "docs/a/b/x1.md", "docs/x1.md", "m.pyc", "m.py", "a.b", "aXb"]
    files = corpus(*[("r", p, "") for p in paths], ("other", "a.log", ""))
    kept = {r.path for r in filters.drop_by_rules(files, rules).where("repo = 'r'").collect()}
    assert kept == {"d/a.log", "keep.log", "src/build/q.c", "docs/x1.md", "m.py", "aXb"}
    assert filters.drop_by_rules(files, rules).where("repo = 'other'").count() == 1
    # Regex signs keep their meaning with `compat`.
    kept = {r.path for r in filters.drop_by_rules(files, rules, compat=True).where("repo = 'r'").collect()}
    assert "aXb" not in kept
    # The last two components only, the repository above the root.
    kept = {r.path for r in filters.drop_by_rules(files, rules, scope="last2").where("repo = 'r'").collect()}
    assert "a.log" in kept and "build/z/q.c" not in kept and "d/a.log" in kept
    # One malformed rule switches off its repository's rules and is reported.
    broken = rules.unionByName(spark.createDataFrame([("r", "[x", False)], rules.schema))
    assert [r.pattern for r in filters.malformed_rules(broken).collect()] == ["[x"]
    assert filters.drop_by_rules(files, broken).where("repo = 'r'").count() == len(paths)
    of_files = filters.rules_of_files(corpus(("r", ".gitignore", "# x\n*.log\n!a\n"), ("r", "sub/.gitignore", "b")))
    assert sorted((r.pattern, r.negated) for r in of_files.collect()) == [("*.log", False), ("a", True)]


def test_report_scan(spark):
    text = (
        "README:\nAbout.\n\nStructure:\nr/\n    a\n\nFile Contents:\nFile: a\nContent:\n one \n\n\n"
        "File: b/c\r\nContent:\r\ntwo\n\nFile: a\nContent:\nthree File: x\n\n"
    )
    reports = spark.createDataFrame([("r", text), ("none", "no sections")], "repo string, text string")
    sections = report_text.report_sections(reports)
    row = sections.where("repo = 'r'").first()
    assert (row.readme, row.structure) == ("README:\nAbout.", "Structure:r/\n    a")
    blocks = report_text.report_blocks(sections).orderBy("ord").collect()
    assert [(b.path, b.content) for b in blocks] == [("a", "three File: x"), ("b/c", "two")]


def test_reduce_report(spark):
    text = "README:\nHi\n\nStructure:\nr/\n    a.rb\n\nFile Contents:\nFile: a.rb\nContent:\nx = 1\n\n"
    reports = spark.createDataFrame([("r", text), ("e", "README:\nStructure:\nFile Contents:\n")], "repo string, text string")
    rows = reduction.reduce_reports(reports, MEDIUM).orderBy("repo", "section", "ord").collect()
    written = lambda repo: "".join(r.text + "\n" for r in rows if r.repo == repo)
    assert written("r") == (
        "README:\nHi\n\nRepository Analysis Summary:\n"
        "Repository contains 1 files with approximately 1 lines of code.\nMain languages: ruby (1).\n"
        "Largest file: a.rb (1 lines).\nKey files include:\n- a.rb\n\n"
        "Structure:r/\n    a.rb\n\nFile Contents:\nFile: a.rb\nContent:\nx = 1\n\n"
    )
    assert written("e") == (
        "README:\n\nRepository Analysis Summary:\nRepository contains 0 files with approximately 0 lines of code.\n\n"
        "Structure:\n\nFile Contents:\n"
    )


def test_one_hot_key_everywhere(corpus):
    """All files in one repository, with one stem and one text."""
    text = "import index\n" + "same words again " * 5
    files = corpus(*[("hot", f"d{i}/index.py", text) for i in range(400)])
    stats = analysis.file_stats(files).collect()
    assert {r.import_count for r in stats} == {399}
    assert duplicates.duplicate_sections(files).first().n_occ == 400
    reduced = reduction.reduce_corpus(files, HEAVY)
    assert reduced.count() == 16


def test_only_likely_stems_are_shuffled(corpus):
    """Prefixes that are no stem of the repository stay in the task that read the text."""
    rows = [("r", f"src/mod_{i}.py", "\n".join([f"import mod_{(i + 1) % 300}", *(f"from lib{i}_{k} import thing{k}" for k in range(20))])) for i in range(300)]
    rows += [("s", f"src/mod_{i}x.py", "import mod_1\nfrom lib3_4 import y") for i in range(50)]
    files = corpus(*rows)
    listed, likely = references.listed_mentions(files), references.likely_mentions(files)
    stems = {(r, p.rsplit("/", 1)[-1][:-3]) for r, p, _ in rows}
    true = sorted((m.repo, m.stem) for m in listed.collect() if (m.repo, m.stem) in stems)
    passed = [(m.repo, m.stem) for m in likely.collect()]
    assert sorted(m for m in passed if m in stems) == true
    assert len(passed) <= len(true) + listed.count() // 1000 and listed.count() > 15 * len(true)


def test_a_full_filter_changes_nothing(corpus, monkeypatch):
    rows = [("r", f"m{i}.py", f"import m{i * 7 % 40}\nfrom m{i % 11}") for i in range(40)]
    expected = sorted(map(tuple, references.reference_count(corpus(*rows)).collect()))
    monkeypatch.setattr(references, "FILTER_WORDS", 1)
    assert sorted(map(tuple, references.reference_count(corpus(*rows)).collect())) == expected


def test_attach_copies_hot_keys_only(spark):
    from corpusmill.functions.joins import attach, hot_keys

    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), F.lit("r").alias("repo"), "id")
    lookup = rows.select("repo", "k").distinct().withColumn("v", F.col("k") * 2)
    hot = spark.range(1).select(hot_keys(rows, ["repo", "k"], 12).alias("hot")).first().hot
    assert list(hot.values()) == [4]
    joined = attach(rows, lookup, ["repo", "k"], ["id"], slots=12)
    assert joined.where("v = 2 * k").count() == 6000 == joined.count()
    assert "Generate explode(sequence(0" in joined._jdf.queryExecution().optimizedPlan().toString()
    empty = attach(rows.limit(0), lookup, ["repo", "k"], ["id"])
    assert empty.count() == 0


def test_meet_gives_the_same_beyond_its_limit(corpus):
    from corpusmill.functions.joins import meet

    files = corpus(*[("hot" if i % 3 else "b", f"{i}.txt", str(i)) for i in range(50)])
    lookup = files.where("ord % 2 = 0").groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    for how in ("left", "inner"):
        rows = [
            sorted(map(tuple, meet(files, lookup, ["repo"], how, spread, limit).collect()))
            for limit in (10**6, 0) for spread in (None, ["path"])
        ]
        assert rows[0] and all(r == rows[0] for r in rows)


def test_file_reduction(corpus):
    before = corpus(("r", "a", "xxxx"), ("r", "b", ""), ("r", "c", "x"))
    after = corpus(("r", "a", "x"), ("r", "b", ""))
    rows = reduction.file_reduction(before, after).orderBy("path").collect()
    assert [(r.chars_before, r.chars_after, r.percent) for r in rows] == [(4, 1, 25.0), (0, 0, None), (1, None, None)]


def test_many_repeats_of_one_section(corpus):
    """A file that repeats one section 50,000 times has one edit, and loses every copy."""
    section = "a section that is long enough to count as one of them"
    files = corpus(("r", "a.txt", section), ("r", "b.txt", "\n\n".join([section] * 50_000)))
    edits = duplicates.replacements(files, 2)
    assert [len(row.edits) for row in edits.collect()] == [1]
    content, joined = F.col("content"), files.join(edits, ["repo", "path"])
    row = joined.select(duplicates.replace_duplicates(content, content, F.col("edits")).alias("c")).first()
    assert section not in row.c and row.c.count("# DUPLICATE CODE") == 50_000


def test_heavy_reduction_of_all_files(corpus):
    """Without a bound on files, heavy reduction drops none and leaves no note."""
    files = corpus(*[("r", f"d/f{i}.txt", f"line {i}\n" * 8) for i in range(40)])
    some = reduction.reduce_corpus(files, HEAVY)
    all_ = reduction.reduce_corpus(files, settings.LEVELS["heavy_all"])
    assert (some.count(), all_.count()) == (16, 40)
    kept = {r.path: r.content for r in some.collect()}
    whole = {r.path: r.content for r in all_.collect()}
    assert all(whole[path] == content for path, content in kept.items() if path in whole)


def test_text_is_read_once(corpus, spark, tmp_path):
    """Ranks, totals and the list of skipped files read settled measures; the summary reads the text once more."""
    rows = [("r", f"d/f{i}.py", f"import f{i + 1}\nx = {i}\n") for i in range(30)]
    corpus(*rows).write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    stats = analysis.measures(files)

    def text_scans(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return sum("FileScan" in line and "content:string" in line for line in plan.split("\n"))

    assert text_scans(analysis.file_stats(files)) == 2
    assert text_scans(ranking.skipped_summary(stats)) == text_scans(ranking.key_files(stats)) == 0
    assert text_scans(analysis.repo_summary(files, stats, HEAVY)) == 1
    assert sorted(stats.collect()) == sorted(analysis.file_stats(files).collect())
    assert ranking.skipped(stats).count() == 15
