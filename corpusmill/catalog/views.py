"""Corpora derived from the given tables, as SQL for Spark and for the check engine.

``documents`` holds prose.  The views give each document a path and turn its lines
into source text by regex, row by row, so they grow with the table:

* ``seeded``  prose with comment lines, blank lines and one import line
* ``code``    text that fits the file's extension (Python, scripts, JSON, HTML, CSS,
  Markdown), root READMEs and lock files
* ``thread``  a repository per conversation and a file per turn

One template serves both dialects; they differ in regex flags and references.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class SparkDialect:
    @staticmethod
    def sub(text: str, pattern: str, replacement: str) -> str:
        for digit in "123":
            replacement = replacement.replace(f"<{digit}>", f"${digit}")
        return f"regexp_replace({text}, r'(?md){pattern}', r'{replacement}')"

    @staticmethod
    def pick(items: list[str], index: str) -> str:
        return f"element_at(array({', '.join(map(repr, items))}), CAST({index} AS INT) + 1)"

    @staticmethod
    def join_groups(text: str, pattern: str, prefix: str) -> str:
        return (
            f"array_join(transform(regexp_extract_all({text}, r'(?md){pattern}', 1), "
            f"x -> concat('{prefix}', x, chr(10))), '')"
        )


class CheckDialect:
    @staticmethod
    def sub(text: str, pattern: str, replacement: str) -> str:
        for digit in "123":
            replacement = replacement.replace(f"<{digit}>", f"\\{digit}")
        return f"regexp_replace({text}, '(?m){pattern}', '{replacement}', 'g')"

    @staticmethod
    def pick(items: list[str], index: str) -> str:
        return f"([{', '.join(map(repr, items))}])[CAST({index} AS INT) + 1]"

    @staticmethod
    def join_groups(text: str, pattern: str, prefix: str) -> str:
        return (
            f"array_to_string(list_transform(regexp_extract_all({text}, '(?m){pattern}', 1), "
            f"lambda x: concat('{prefix}', x, chr(10))), '')"
        )


_DIRS = ["src", "tests", "docs", "node_modules", "lib", "app", "build", "pkg"]
_EXTS = [".py", ".js", ".ts", ".md", ".json", ".html", ".css", ".txt", ".png", ".min.js", ".java", ".yml"]
_LOCKS = ["package-lock.json", "LICENSE", "tsconfig.json", ".eslintrc"]
_NAME = """CASE WHEN doc_id % 97 = 0 THEN 'main' WHEN doc_id % 11 = 0 THEN concat('test_', doc_id)
                ELSE concat('doc_', doc_id) END"""


def _seeded_content(d) -> str:
    text = d.sub("text", "^([A-M])", "# <1>")
    text = d.sub(text, "^(T)", "\n<1>")
    return f"concat({text}, chr(10), 'import doc_', (doc_id * 21) % 200)"


def seeded_sql(d) -> str:
    return f"""SELECT source AS repo, doc_id AS ord,
        concat(lang, '/', {d.pick(_DIRS, 'doc_id % 8')}, '/', {_NAME}, {d.pick(_EXTS, 'doc_id % 12')}) AS path,
        {_seeded_content(d)} AS content
    FROM documents"""


def _python(d) -> str:
    """A class per document; sentences become methods, helpers, comments, docstrings."""
    body = d.sub("sentences", "^([N-S].*)$", "        # <1>")
    body = d.sub(body, "^([U-Z][a-z]*)(.*)$", '        """<1>\n        :param x: <2>\n        Returns: y\n        """')
    body = d.sub(body, "^([A-F][a-z]*)(.*)$", '    def <1>(self):\n        return "<2>"')
    body = d.sub(body, "^([G-M][a-z]*)(.*)$", '    def _<1>(self):\n        x = ["<2>"]\n\n        y = {"<2>"}   # last')
    body = d.sub(body, "^([^ ].*)$", "        # note\n        z = 1  # <1>\n        # end   ")
    imports = d.join_groups("sentences", "^T([a-z]+)", "import t")
    chosen = d.join_groups("sentences", "^O([a-z]+)", "from pkg.mod import base as b, o")
    return f"concat({imports}, {chosen}, 'class Doc', doc_id, ':', chr(10), {body}, chr(10), 'def run():', chr(10), '    pass', chr(10))"


def _script(d, quote: str) -> str:
    body = d.sub("sentences", "^([A-F][a-z]*)(.*)$", 'import <1> from "./lib/<1>";')
    body = d.sub(body, "^([G-M][a-z]*)(.*)$", "const <1> = {\n  a: 1,\n  b: 2,\n  c: 3,\n  d: 4,\n  e: 5,\n};")
    body = d.sub(body, "^(T.*)$", "// <1>")
    return f"replace({body}, '\"', {quote})"


def _json(d) -> str:
    items = d.sub("replace(replace(text, chr(92), ' '), '\"', ' ')", r"[\x00-\x09\x0b-\x1f]", " ")
    array = d.sub(items, "^(.*)$", ' "<1>"')
    array = f"concat('[', replace({array}, concat('\"', chr(10)), concat('\",', chr(10))), ']')"
    entry = d.sub(items, "^([^ ]*)(.*)$", ' "<1>": {"rest": "<2>"}')
    entry = f"concat('{{', replace({entry}, concat('}}', chr(10)), concat('}},', chr(10))), '}}')"
    return f"CASE WHEN doc_id % 24 < 12 THEN {array} ELSE {entry} END"


def _html(d) -> str:
    body = d.sub("sentences", "^(T.*)$", "<!-- <1> -->")
    body = d.sub(body, "^([A-Z].*)$", "  <li><1></li>")
    return f"concat('<ul>', chr(10), {body}, chr(10), '</ul>', chr(10))"


def _css(d) -> str:
    body = d.sub("sentences", "^(T.*)$", "/* <1> */")
    body = d.sub(body, "^([AE][a-z]*).*$", "-webkit-<1>: none;")
    # Words become properties of the rule of their sentence.
    body = d.sub(body, "([A-Za-z]+)[ ,.]+", "<1>: 1; ")
    return d.sub(body, "^([B-Z].*)$", ".r { <1> }")


def code_sql(d) -> str:
    markdown = d.sub("sentences", "^([A-M])", "## <1>")
    sentences = d.sub("text", r"\. ", ".\n")
    return f"""SELECT source AS repo, doc_id AS ord,
        CASE WHEN doc_id < 10 THEN 'README.md' WHEN doc_id < 15 THEN 'README.txt'
             WHEN doc_id BETWEEN 20 AND 24 THEN 'README' WHEN doc_id BETWEEN 25 AND 29 THEN 'README.txt'
             WHEN doc_id % 13 = 0 THEN concat(lang, '/', {d.pick(_DIRS[:7], 'doc_id % 7')}, '/p', doc_id, '/', {d.pick(_LOCKS, 'doc_id % 4')})
             ELSE concat(lang, '/', {d.pick(_DIRS[:7], 'doc_id % 7')}, '/', {_NAME}, {d.pick(_EXTS, 'doc_id % 12')}) END AS path,
        CASE doc_id % 12 WHEN 0 THEN {_python(d)} WHEN 1 THEN {_script(d, "'\"'")} WHEN 2 THEN {_script(d, "chr(39)")}
             WHEN 3 THEN {markdown} WHEN 4 THEN {_json(d)} WHEN 5 THEN {_html(d)} WHEN 6 THEN {_css(d)}
             ELSE {_seeded_content(d)} END AS content
    FROM (SELECT doc_id, source, lang, text, {sentences} AS sentences FROM documents)"""


def thread_sql(d) -> str:
    names = ["README", "README.txt", "notes.md", "README.md", "src/main.py", "src/test_app.js", "lib/util.py", "data.json"]
    return f"""SELECT concat('conv', conv_id) AS repo, turn AS ord,
        CASE WHEN (conv_id + turn) % 9 = 8 OR turn > 7 THEN concat('turn_', turn, '.txt')
             ELSE {d.pick(names, 'turn % 8')} END AS path,
        text AS content
    FROM conversations"""


def python_sql(d) -> str:
    """Every document as a Python file."""
    sentences = d.sub("text", r"\. ", ".\n")
    return f"""SELECT source AS repo, doc_id AS ord, concat(lang, '/doc_', doc_id, '.py') AS path, {_python(d)} AS content
    FROM (SELECT doc_id, source, lang, {sentences} AS sentences FROM documents)"""


def css_sql(d) -> str:
    """Every document as a style sheet."""
    sentences = d.sub("text", r"\. ", ".\n")
    return f"""SELECT source AS repo, doc_id AS ord, concat(lang, '/doc_', doc_id, '.css') AS path, {_css(d)} AS content
    FROM (SELECT doc_id, source, lang, {sentences} AS sentences FROM documents)"""


def script_sql(d) -> str:
    """Every document as a script; some of its sentences are elements, of which some share a name or its beginning."""
    sentences = d.sub("text", r"\. ", ".\n")
    body = d.sub(_script(d, "'\"'"), "^(S[a-z]*) (.*)$", '<<1> title="<2>">\n<2>\n  <2>\n</<1>>')
    return f"""SELECT source AS repo, doc_id AS ord, concat(lang, '/doc_', doc_id, '.js') AS path, {body} AS content
    FROM (SELECT doc_id, source, lang, {sentences} AS sentences FROM documents)"""


def json_sql(d) -> str:
    """Every document as a JSON array or object."""
    return f"""SELECT source AS repo, doc_id AS ord, concat(lang, '/doc_', doc_id, '.json') AS path, {_json(d)} AS content
    FROM documents"""


def records_sql(d) -> str:
    """Every document as a JSON array or object with numbers, nesting, nulls, escapes and, in objects, keys that come again."""
    lines = d.sub(d.sub("replace(replace(text, chr(92), ' '), '\"', ' ')", r"[\x00-\x09\x0b-\x1f]", " "), r"\. ", ".\n")
    value = r'{"rest": "<2>", "n": [1, 2.50, -3e2, null, true, {}], "q": "a\\\\"b" }'
    array = d.sub(lines, "^(..?)(.*)$", f' "<1>", -7, 0.25, null, [[ ], "x"], {value}')
    entry = d.sub(lines, "^(..?)(.*)$", f' "<1>" : {value}')
    joined = lambda text: f"replace({text}, concat('}}', chr(10)), concat('}},', chr(10)))"
    return f"""SELECT source AS repo, doc_id AS ord, concat(lang, '/doc_', doc_id, '.json') AS path,
        CASE WHEN doc_id % 2 = 0 THEN concat('[', {joined(array)}, ' ]') ELSE concat('{{', {joined(entry)}, ' }}') END AS content
    FROM documents"""


def pages_sql(d) -> str:
    return "SELECT 'pages' AS repo, page_id AS ord, concat('page_', page_id, '.html') AS path, html AS content FROM pages"


VIEWS = {
    "seeded": (seeded_sql, "documents", ["doc_id"]),
    "code": (code_sql, "documents", ["doc_id"]),
    "python": (python_sql, "documents", ["doc_id"]),
    "css": (css_sql, "documents", ["doc_id"]),
    "script": (script_sql, "documents", ["doc_id"]),
    "json": (json_sql, "documents", ["doc_id"]),
    "records": (records_sql, "documents", ["doc_id"]),
    "thread": (thread_sql, "conversations", ["conv_id", "turn"]),
    "pages": (pages_sql, "pages", ["page_id"]),
}


def load(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """A view over the tables in ``sf_dir``: ``(repo, ord, path, content)``.

    A table that comes in fewer parts than there are cores (the small test tables
    are one part) is dealt over the cores; larger tables stay as they are read.
    """
    make, table, key = VIEWS[view]
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if source.rdd.getNumPartitions() < cores:
        source = source.repartition(cores, *key)
    source.createOrReplaceTempView(f"source_{table}")
    return spark.sql(make(SparkDialect).replace(f"FROM {table}", f"FROM source_{table}"))


def check_sql(view: str) -> str:
    return VIEWS[view][0](CheckDialect)
