"""Column expressions against their Python meaning."""

import os
import random

from pyspark.sql import functions as F

from corpusmill.functions import paths, text
from corpusmill.operators import filters

SIGNS = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]


def _random_texts(n=400):
    rng = random.Random(7)
    alphabet = SIGNS + ["a", "b c", "é", "😀", " ", "\t", "\x1f", "\xa0", ""]
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 9))) for _ in range(n)] + ["", "\n", "x", "x\n", "\r\n"]


def test_lines_are_those_of_a_universal_split(apply):
    texts = _random_texts()
    assert apply(text.split_lines, *texts) == [t.splitlines() for t in texts]
    assert apply(text.line_count, *texts) == [len(t.splitlines()) for t in texts]
    assert apply(text.plain_lines, *texts) == ["\n".join(t.splitlines()) for t in texts]


def test_strip_is_unicode_aware(apply):
    texts = _random_texts()
    assert apply(text.strip, *texts) == [t.strip() for t in texts]
    assert apply(text.lstrip, *texts) == [t.lstrip() for t in texts]


def test_text_size(apply):
    assert apply(F.length, "a😀é") == 3
    assert apply(F.octet_length, "a😀é") == 7


def test_path_parts(apply):
    names = ["a/b.py", "b.tar.gz", ".bashrc", "x/.hidden.txt", "a.b/c", "...", "..a.b", "dir/a.", "a..b", "é/ü.MD", "x/y/z"]
    assert apply(paths.extension, *names) == [os.path.splitext(n)[1] for n in names]
    assert apply(paths.stem, *names) == [os.path.splitext(os.path.basename(n))[0] for n in names]
    assert apply(paths.basename, *names) == [os.path.basename(n) for n in names]
    assert apply(paths.dirname, *names) == [os.path.dirname(n) for n in names]
    assert apply(paths.language, "A/B.PY", "x.tsx", "Makefile", "a.yaml") == ["python", "react", "unknown", "yaml"]


def test_rewrite_matches_computes_from_each_match(apply):
    rewrite = lambda t: text.rewrite_matches(t, r"\d+", lambda m: F.concat(F.lit("<"), m, F.lit(">")))
    assert apply(rewrite, "1a22b", "none", "", "33") == ["<1>a<22>b", "none", "", "<33>"]


def test_built_in_lists(apply):
    ignored = lambda p: filters.built_in_ignored(p)
    assert apply(
        ignored, "a/build/x.py", "build", "src/LICENSE", "a/license", "p.PNG", "a/x.min.js", "xmin.js", "build.py", "a/b/.git/c/d"
    ) == [True, False, True, False, True, True, False, False, True]
    guess = lambda p: filters.built_in_ignored(p, compat_dir_guess=True)
    # Without an extension the name is looked up among directories only.
    assert apply(guess, "LICENSE", "bin", "a.png", "README.md") == [False, True, True, True]


def test_skip_list(spark, apply, corpus):
    assert apply(lambda p: filters.is_skipped(p, ["docs", "a.py"]), "docs/x", "x/a.py", "x/docs.md") == [True, True, False]
    files = corpus(("r", "docs/x", ""), ("r", "x/a.py", ""), ("s", "docs/x", ""))
    skip = spark.createDataFrame([("r", "docs")], "repo string, name string")
    kept = filters.drop_skipped(files, skip).orderBy("ord").collect()
    assert [(k.repo, k.path) for k in kept] == [("r", "x/a.py"), ("s", "docs/x")]
