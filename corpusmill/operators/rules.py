"""Reduction rules by language.

Rules that are one regex are rows of :data:`RULES`: the same rows are chained into
the reduction and measured by :func:`rule_effects`.  The others compute their
replacement from the match and are functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import paths, text
from corpusmill.operators import imports, lines, symbols
from corpusmill.settings import Level


# Patterns and notes below are fixed values: results depend on them.


@dataclass(frozen=True)
class Rule:
    """A regex rule; no languages means every language with generic reduction.

    ``closing`` is what every match ends with.  Text behind its last occurrence holds
    no match and is left out, so openings without an end are not searched to the end
    of the text one by one.
    """

    name: str
    pattern: str
    replacement: str
    languages: tuple[str, ...] = ()
    heavy: bool = False
    closing: str = ""


_SCRIPT = ("javascript", "typescript")
_VENDOR = r"(?:-webkit-|-moz-|-ms-|-o-)"

RULES = {
    rule.name: rule
    for rule in (
        Rule("blank_runs", rf"\n(?:[{text.GAP}]*+\n){{2,}}+", "\n\n"),
        Rule("trailing_blanks", r"(?md)(?=[ \t])(?<![ \t])[ \t]++$", ""),
        Rule("inner_spaces", rf"(?=[ \t]{{2}})(?<=[^{text.SPACE}])[ \t]++(?=[^{text.SPACE}])", " ", heavy=True),
        Rule("long_list", r"\[[^\]]{50,}+\]", "[...]  # List with elements", ("python",)),
        Rule("long_dict", r"\{[^}]{50,}+\}", "{...}  # Dict with key-values", ("python",)),
        # Never fires after long_list, which takes every bracket of this length.
        Rule("long_comprehension", r"\[[^\]]{50,}? for [^\]]++\]", "[... for ... in ...]  # List comprehension", ("python",)),
        Rule("object_literal", r"\{(?:[^{\n]*+\n){5}(?:[^{]*\n)?[^}]*+\}", "{ /* Large object literal */ }", _SCRIPT),
        Rule(
            "jsx_element",
            r"<([A-Z][a-zA-Z0-9]*)([^>]{50,}?)>[\s\S]{100,}?</\1>",
            "<$1 /* props */ >/* complex component content */</$1>",
            _SCRIPT,
            heavy=True,
            closing="</",
        ),
        Rule("html_comment", r"(?s)<!--.*?-->", "", ("html",), closing="-->"),
        Rule("html_gap", rf">[{text.SPACE}]++<", ">\n<", ("html",)),
        Rule("css_comment", r"(?s)/\*.*?\*/", "", ("css",), closing="*/"),
    )
}


def closed_part(content: Column, closing: str, work: Callable[[Column], Column]) -> Column:
    """``work`` on the text up to its last ``closing`` sign; the rest follows as it is."""

    def both(t: Column, rest: Column) -> Column:
        closed = F.substr(t, F.lit(1), F.length(t) - F.length(rest))
        return F.when(t.contains(closing), F.concat(work(closed), rest)).otherwise(t)

    return text.let(content, lambda t: text.let(F.substring_index(t, closing, -1), lambda rest: both(t, rest)))


_NAME = "[A-Z][a-zA-Z0-9]*"
_LEAST_CHILDREN = 100


def mark_unclosed(content: Column) -> Column:
    """Openings of elements that no closing tag of their name follows far enough on get a stand-in for ``<``.

    The last closing tag of every name is looked up, so no opening is searched to the
    end of the text in vain.  A shorter name that an opening begins with counts as well.
    """

    def rebuild(t: Column, names: Column, segments: Column) -> Column:
        size = F.transform(names, lambda name: F.length(name) + 3)
        gaps = F.slice(F.split(t, f"</{_NAME}>", -1), F.lit(1), F.size(names))
        ends = text.running_sums(F.zip_with(gaps, size, lambda gap, n: (F.length(gap) + n).cast("bigint")))
        tags = F.array_sort(F.zip_with(names, ends, lambda name, end: F.struct(name.alias("name"), (end - F.length(name) - 3).alias("at"))))

        def lasts(sorted_tags: Column) -> Column:
            def is_last(tag: Column, i: Column) -> Column:
                after = F.get(sorted_tags, i + 1)["name"]
                return after.isNull() | (after != tag["name"])

            return F.map_from_entries(F.filter(sorted_tags, is_last))

        longest = F.coalesce(F.array_max(F.transform(names, F.length)), F.lit(0))
        stops = text.running_sums(F.transform(segments, lambda part: (F.length(part) + 1).cast("bigint")))

        def mark(segment: Column, stop: Column, last: Column) -> Column:
            def kept(hit: Column) -> Column:
                most = F.least(F.length(hit) - 1, longest)
                closed = F.exists(
                    F.when(most > 0, F.sequence(F.lit(1), most)),
                    # The sign > stands at stop - 1.
                    lambda n: F.coalesce(F.try_element_at(last, F.substr(hit, F.lit(2), n)) >= stop + _LEAST_CHILDREN, F.lit(False)),
                )
                return F.when(closed, hit).otherwise(F.concat(F.lit(text.STAND_IN), F.substr(hit, F.lit(2), F.length(hit))))

            return F.when(segment.rlike("<[A-Z]"), text.rewrite_matches(segment, f"<{_NAME}", kept)).otherwise(segment)

        def with_lasts(last: Column) -> Column:
            return F.array_join(F.zip_with(segments, stops, lambda segment, stop: mark(segment, stop, last)), ">")

        return text.let(text.let(tags, lasts), with_lasts)

    return text.let(
        content,
        lambda t: text.let(text.find_all(t, f"</({_NAME})>", 1), lambda names: text.let(F.split(t, ">", -1), lambda parts: rebuild(t, names, parts))),
    )


def prepared(content: Column, name: str) -> Column:
    """The text in which the rule is looked for."""
    if RULES[name].closing != "</":
        return content
    marked = text.let(content, lambda t: F.when(t.contains(text.STAND_IN) | ~t.rlike("<[A-Z]"), t).otherwise(mark_unclosed(t)))
    return F.when(content.contains("</"), marked).otherwise(content)


def apply_rule(content: Column, name: str) -> Column:
    rule = RULES[name]
    if not rule.closing:
        return F.regexp_replace(content, rule.pattern, rule.replacement)
    if rule.closing == "</":  # the name of the element follows

        def replaced(t: Column) -> Column:
            done = F.regexp_replace(prepared(t, name), rule.pattern, rule.replacement)
            return F.when(t.contains(text.STAND_IN), done).otherwise(F.replace(done, F.lit(text.STAND_IN), F.lit("<")))

        return closed_part(content, ">", lambda t: F.when(t.contains("</"), text.let(t, replaced)).otherwise(t))
    return closed_part(content, rule.closing, lambda t: F.regexp_replace(t, rule.pattern, rule.replacement))


# --- generic ----------------------------------------------------------------

_DOCSTRING = r'"""[\s\S]*?"""|' + r"'''[\s\S]*?'''"
# Signs of documented parameters, results and examples.
_PARAMS = r"@param|@arg|:param|:arg|Parameters:"
_RETURNS = r"@return|:return|Returns:"
_EXAMPLES = r"@example|Example:|Examples:"


def collapse_docstrings(content: Column, level: Level) -> Column:
    """Triple-quoted strings of more than three lines: first, a note, last."""

    def shorten(docstring: Column, parts: Column) -> Column:
        size = F.size(parts).cast("string")
        n_params = text.count_of(docstring, _PARAMS)
        facts = F.concat_ws(
            ", ",
            F.when(n_params > 0, F.concat(n_params.cast("string"), F.lit(" params"))),
            F.when(docstring.rlike(_RETURNS), F.lit("return info")),
            F.when(docstring.rlike(_EXAMPLES), F.lit("examples")),
        )
        if level.heavy:
            note = F.concat(F.lit("# Compressed "), size, F.lit(" line docstring"))
        else:
            told = F.when(facts != "", facts).otherwise(F.concat(size, F.lit(" lines")))
            note = F.concat(F.lit("# Compressed docstring ("), told, F.lit(")"))
        short = F.concat_ws("\n", F.element_at(parts, 1), note, F.element_at(parts, -1))
        return F.when(F.size(parts) > 3, short).otherwise(docstring)

    return text.rewrite_matches(
        content, _DOCSTRING, lambda d: text.let(text.split_lines(d), lambda parts: shorten(d, parts))
    )


def generic(content: Column, level: Level) -> Column:
    """The chain that fits every language."""
    out = collapse_docstrings(content, level)
    out = lines.collapse_comment_runs(out, level)
    out = apply_rule(out, "blank_runs")
    out = apply_rule(out, "trailing_blanks")
    if level.heavy:
        out = lines.cut_long_lines(apply_rule(out, "inner_spaces"))
    return out


# --- by language ------------------------------------------------------------


def python(content: Column, level: Level) -> Column:
    """On text that went through :func:`generic`."""
    out = imports.summarise_python(content, level.import_threshold)
    out = symbols.shorten_symbols(out, level)
    for name in ("long_list", "long_dict", "long_comprehension"):
        out = apply_rule(out, name)
    return out


def script(content: Column, level: Level, compat: bool = False) -> Column:
    """JavaScript and TypeScript, on text that went through :func:`generic`."""
    out = imports.summarise_javascript(content, level.import_threshold, compat)
    out = apply_rule(out, "object_literal")
    return apply_rule(out, "jsx_element") if level.heavy else out


_JSON_TOKEN_OR_SPACE = r'("(?:[^"\\]|\\.)*+")|\s++'


def compact_json(content: Column) -> Column:
    """White space outside strings goes; order and numbers stay as written."""
    return F.regexp_replace(content, _JSON_TOKEN_OR_SPACE, "$1")


_JSON_TOKEN = r'"(?:[^"\\]|\\.)*+"|[\[\]{},:]|[^\s\[\]{},:"]++'
_JSON_NUMBER = r"^-?[0-9]+(?:\.|[eE])"
_JSON_PLAIN_TOKEN = r"^(?:[\[\]{},:]|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null)$"


# Text whose brackets lie within each other up to a fixed depth is read by regex alone: whole, strictly, and by entries.
_JSON_LEVELS = 6
_JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_JSON_STRICT_STRING = r'"[^"\\\x00-\x1f]*+(?:\\[^\x00-\x1f][^"\\\x00-\x1f]*+)*+"'
_JSON_STRICT_PLAIN = r'(?:-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+|true|false|null)(?=[\s\[\]{},:"])'


def _json_nested(other: str, levels: int) -> str:
    """A pair of brackets with such text and as many levels of further pairs at most within it."""
    pair = rf"[\[{{](?:{other})*+[\]}}]"
    for _ in range(levels):
        pair = rf"[\[{{](?:{other}|{pair})*+[\]}}]"
    return pair


_JSON_STRICT = rf"\A\s*+{_json_nested(rf'[\s,:]++|{_JSON_STRICT_STRING}|{_JSON_STRICT_PLAIN}', _JSON_LEVELS)}\s*+\z"
_JSON_VALUE = rf'(?:{_JSON_STRING}|[^\s\[\]{{}},:"]++|{_json_nested(rf"{_JSON_STRING}|[^\[\]{{}}" + chr(34) + r"]++", _JSON_LEVELS - 1)})'
_JSON_ENTRY = rf"({_JSON_STRING})\s*+:\s*+({_JSON_VALUE})"


def _json_written(tokens: Column) -> Column:
    """Compact text of some tokens; numbers with a fraction or an exponent as a reader of numbers writes them."""
    shown = F.transform(tokens, lambda t: F.when(t.rlike(_JSON_NUMBER), t.cast("double").cast("string")).otherwise(t))
    return F.array_join(shown, "")


def json_sample(content: Column, level: Level) -> Column:
    """Large arrays and objects become a note and their first entries.

    Entries are cut from the source, so what stands in them keeps its order.  Of a key that
    comes again the first place and the last value count; keys within entries stay as they are.
    Regexes cut text whose brackets are not too deep; other text is cut by the depth of its brackets.
    """

    def readable(kind: Column) -> Column:
        return F.when(kind == "[", F.json_array_length(content).isNotNull()).otherwise(F.json_object_keys(content).isNotNull())

    def written(value: Column) -> Column:
        return _json_written(text.find_all(value, _JSON_TOKEN))

    def small() -> Column:
        return F.when(F.length(content) < 1000, compact_json(content)).otherwise(content)

    def array_form(n_items: Column, first: Callable[[int], Column]) -> Column:
        """``first``: the first entries as they are written."""

        def note(keep: int) -> Column:
            what = F.lit(f" items. First {keep} items:\n" if keep > 1 else " items. First item:\n")
            shown = F.concat(F.lit("["), first(keep), F.lit("]")) if keep > 1 else first(keep)
            return F.concat(F.lit("// JSON array with "), n_items.cast("string"), what, shown)

        chosen = F.when(n_items > 10, note(3))
        if level.heavy:
            chosen = chosen.when(n_items > 3, note(1))
        return chosen.otherwise(small())

    def object_form(keys: Column, value: Callable[[Column], Column]) -> Column:
        """``keys`` as in the source; ``value``: what is written for the entry of a number, counted from 0."""

        def unquoted(token: Column) -> Column:
            escaped = F.get_json_object(F.concat(F.lit("["), token, F.lit("]")), "$[0]")
            return F.when(token.contains("\\"), escaped).otherwise(F.substr(token, F.lit(2), F.length(token) - 2))

        def entry(name: Column, names: Column) -> Column:
            # The last entry of this name, counted from 0.
            at = F.size(names) - F.array_position(F.reverse(names), name).cast("int")
            # A one-entry map gives the key its JSON quoting.
            key = F.regexp_replace(F.to_json(F.map_from_arrays(F.array(name), F.array(F.lit(0)))), r"^\{|0\}\z", "")
            return F.concat(key, value(at))

        def form(names: Column, distinct: Column) -> Column:
            def listed(some: Column) -> Column:
                return F.concat(F.lit("{"), F.array_join(F.transform(some, lambda name: entry(name, names)), ","), F.lit("}"))

            def note(keep: int) -> Column:
                some = F.slice(distinct, 1, keep)
                return F.concat(
                    F.lit("// JSON object with "), F.size(distinct).cast("string"), F.lit(" keys. Sample keys: "),
                    F.array_join(some, ", "), F.lit("...\n"), listed(some),
                )

            chosen = F.when(F.size(distinct) > 20, note(5))
            if level.heavy:
                chosen = chosen.when(F.size(distinct) > 5, note(3))
            short = F.when(F.size(distinct) == F.size(names), compact_json(content)).otherwise(listed(distinct))
            return chosen.otherwise(F.when(F.length(content) < 1000, short).otherwise(content))

        return text.let(
            F.transform(keys, unquoted),
            lambda names: text.let(F.array_distinct(names), lambda distinct: form(names, distinct)),
        )

    # What is between the outer brackets.
    inner = F.regexp_replace(content, r"\A\s*+[\[{]|[\]}]\s*+\z", "")

    def by_values(part: Column) -> Column:
        def first(values: Column, keep: int) -> Column:
            return F.array_join(F.transform(F.slice(values, 1, keep), written), ",")

        return text.let(text.find_all(part, _JSON_VALUE), lambda values: array_form(F.size(values), lambda keep: first(values, keep)))

    def by_entries(part: Column) -> Column:
        return text.let(
            text.find_all(part, _JSON_ENTRY, 2),
            lambda values: object_form(text.find_all(part, _JSON_ENTRY, 1), lambda at: written(F.get(values, at))),
        )

    def by_depth(kind: Column, tokens: Column, depth: Column) -> Column:
        n = F.size(tokens)
        places = F.sequence(F.lit(1), n)
        commas = F.filter(places, lambda i: (F.get(tokens, i - 1) == ",") & (F.get(depth, i - 1) == 1))
        # Nothing but white space stands behind the bracket that closes the first one.
        whole = F.array_position(depth, F.lit(0).cast("bigint")) == n
        edges = F.when(n > 2, F.concat(F.array(F.lit(1)), commas, F.array(n))).otherwise(F.array(F.lit(1)))
        # The reader takes control signs and single quotes as well, which are no JSON.
        strict = F.forall(
            tokens,
            lambda t: F.when(t.startswith('"'), ~t.rlike(r"[\x00-\x1f]")).otherwise(t.rlike(_JSON_PLAIN_TOKEN)),
        )

        def cut(e: Column) -> Column:
            def first(keep: int) -> Column:
                return _json_written(F.slice(tokens, F.lit(2), F.get(e, F.lit(keep)) - 2))

            def value(at: Column) -> Column:
                begin, end = F.get(e, at), F.get(e, at + 1)
                return _json_written(F.slice(tokens, begin + 3, end - begin - 3))

            keys = F.transform(F.slice(e, F.lit(1), F.size(e) - 1), lambda begin: F.get(tokens, begin))
            return F.when(kind == "[", array_form(F.size(e) - 1, first)).otherwise(object_form(keys, value))

        return F.when(whole & readable(kind) & strict, text.let(edges, cut)).otherwise(content)

    def by_tokens(kind: Column) -> Column:
        def with_depth(tokens: Column) -> Column:
            steps = F.transform(
                tokens, lambda t: F.when(t.isin("[", "{"), 1).when(t.isin("]", "}"), -1).otherwise(0).cast("bigint")
            )
            return text.let(text.running_sums(steps), lambda depth: by_depth(kind, tokens, depth))

        return text.let(text.find_all(content, _JSON_TOKEN), with_depth)

    def cut_up(kind: Column) -> Column:
        by_regex = F.when(kind == "[", text.let(inner, by_values)).otherwise(text.let(inner, by_entries))
        return F.when(~readable(kind), content).when(content.rlike(_JSON_STRICT), by_regex).otherwise(by_tokens(kind))

    single = content.rlike(rf"\A\s*+(?:{_JSON_TOKEN})\s*+\z") & F.try_parse_json(content).isNotNull()
    plain = F.when(single & (F.length(content) < 1000), compact_json(content)).otherwise(content)
    return text.let(
        F.regexp_extract(content, r"\A\s*+(.)", 1),
        lambda kind: F.when(kind.isin("[", "{"), cut_up(kind)).otherwise(plain),
    )


def _item(tag: str) -> str:
    return rf"<{tag}\b[^>]*>[\s\S]*?</{tag}>"


def trim_items(content: Column, tag: str, what: str) -> Column:
    """Pages with more than five such items: in each run of five or more adjacent
    ones keep two and a comment with the number of the others on the page.

    A run needs four places at which an item follows another one, so what opens behind the
    fourth last of them begins none: such openings stand for text while runs are
    looked for, and the search never runs to the end of the page in vain.
    """
    item = _item(tag)
    gap = rf"[{text.SPACE}]*"
    run = rf"({item})({gap}{item})(?:{gap}{item}){{3}}(?:{gap}{item})*+"
    meeting = rf"(?<=</{tag}>)(?={gap}+<{tag}\b[^>]*>)"
    least = 4

    def trim(page: Column, parts: Column) -> Column:
        note = F.concat(
            F.lit("$1$2\n<!-- ... and "), (text.count_of(page, item) - 2).cast("string"), F.lit(f" more {what} ... -->")
        )
        # All openings of a late part but the one that it begins with.
        def late_part(part: Column) -> Column:
            head = F.regexp_extract(part, rf"\A[{text.SPACE}]*+<", 0)
            rest = F.substr(part, F.length(head) + 1, F.length(part))
            return F.concat(head, F.regexp_replace(rest, rf"<(?={tag}\b)", text.STAND_IN))

        late = F.transform(F.slice(parts, -least, least), late_part)
        early = F.slice(parts, F.lit(1), F.size(parts) - least)
        marked = F.array_join(F.concat(early, late), "")
        trimmed = F.replace(F.regexp_replace(marked, F.lit(run), note), F.lit(text.STAND_IN), F.lit("<"))
        plain = F.regexp_replace(page, F.lit(run), note)
        return (
            F.when((F.size(parts) <= least) | (text.count_of(page, item) <= 5), page)
            .when(page.contains(text.STAND_IN), plain)
            .otherwise(trimmed)
        )

    return closed_part(content, f"</{tag}>", lambda t: text.let(t, lambda page: text.let(F.split(page, meeting, -1), lambda parts: trim(page, parts))))


def html(content: Column, level: Level) -> Column:
    out = apply_rule(apply_rule(content, "html_comment"), "html_gap")
    if level.heavy:
        out = trim_items(out, "li", "list items")
        out = trim_items(out, "tr", "table rows")
    return out


def css(content: Column, level: Level) -> Column:
    def drop_vendor(sheet: Column) -> Column:
        dropped = F.concat(
            F.lit("/* Note: Vendor prefixes consolidated */\n"),
            F.regexp_replace(sheet, rf"(?md)^[{text.SPACE}]*+{_VENDOR}[^\n]*?;[{text.SPACE}]*$", ""),
        )
        return F.when(text.count_of(sheet, rf"{_VENDOR}[^\n]*?;") > 5, dropped).otherwise(sheet)

    def shorten(rule: Column) -> Column:
        parts = F.split(F.substr(rule, F.lit(2), F.length(rule) - 2), ";", -1)
        n_properties = F.size(parts) - 1
        short = F.concat(
            F.lit("{"),
            F.array_join(F.slice(parts, 1, 4), ";"),
            F.lit("; /* ... "),
            (n_properties - 4).cast("string"),
            F.lit(" more properties ... */}"),
        )
        return F.when(n_properties > 8, short).otherwise(rule)

    out = text.let(apply_rule(content, "css_comment"), drop_vendor)
    if level.heavy:
        out = text.rewrite_matches(out, r"(?<=[^{}])\{[^{}]++\}", shorten)
    return out


# Languages whose reduction does not go through the generic chain.
_NOT_GENERIC = ("json", "html", "css")


def by_language(content: Column, language: Column, level: Level) -> Column:
    """The reduction for a file's language, else the generic one."""

    def dispatch(t: Column, tidy: Column) -> Column:
        chosen = (
            F.when(language == "python", python(tidy, level))
            .when(language.isin(*_SCRIPT), script(tidy, level))
            .when(language == "json", json_sample(t, level))
            .when(language == "html", html(t, level))
            .when(language == "css", css(t, level))
        )
        if level.heavy:
            chosen = chosen.when(language == "markdown", lines.heading_sections(t, tidy))
        return chosen.otherwise(tidy)

    return text.let(
        content,
        lambda t: text.let(
            F.when(language.isin(*_NOT_GENERIC), t).otherwise(generic(t, level)), lambda tidy: dispatch(t, tidy)
        ),
    )


# --- measures ---------------------------------------------------------------

def rule_effects(files: DataFrame, names: list[str] | None = None) -> DataFrame:
    """What each regex rule does to each language, on the text as it is:
    hits, files touched and characters saved.

    Rules are measured in one pass; a file is tested with the rules of its
    language only, and one row of counts per rule leaves it.
    """
    content = F.col("content")
    language = paths.language(F.col("path"))

    def measure(rule: Rule) -> Column:
        applies = F.col("lang").isin(*rule.languages) if rule.languages else ~F.col("lang").isin(*_NOT_GENERIC)
        return F.when(
            applies,
            F.struct(
                F.lit(rule.name).alias("rule"),
                text.count_of(prepared(content, rule.name), rule.pattern).cast("bigint").alias("hits"),
                (F.length(content) - F.length(apply_rule(content, rule.name))).cast("bigint").alias("saved"),
            ),
        )

    measured = files.select("content", language.alias("lang")).select(
        "lang", F.explode(F.array(*[measure(RULES[name]) for name in names or RULES])).alias("m")
    )
    return (
        measured.where("m IS NOT NULL AND m.hits > 0")
        .groupBy(F.col("m.rule").alias("rule"), "lang")
        .agg(
            F.sum("m.hits").alias("hits"),
            F.count(F.lit(1)).alias("files_touched"),
            F.sum("m.saved").alias("chars_saved"),
        )
    )
