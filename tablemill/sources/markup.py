"""XML rows and HTML tables."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.text import field, named, stripped
from tablemill.sources.files import file_path, require_paths


def _blank_to_null(text: Column) -> Column:
    clean = stripped(text)
    return F.when(clean != "", clean)


def _steps(xpath: str) -> list[str]:
    """Element names of a relative path; an attribute keeps its ``@``. Prefixes go, names match without them."""
    if "[" in xpath or "*" in xpath or ".." in xpath or "//" in xpath:
        raise ValueError(f"a field is a plain relative path, not {xpath!r}")
    parts = [p for p in xpath.strip().removesuffix("text()").split("/") if p not in ("", ".")]
    return [("@" if p.startswith("@") else "") + p.lstrip("@").rsplit(":", 1)[-1] for p in parts] or ["_VALUE"]


@dataclass(frozen=True)
class _Test:
    """One predicate: a place among the elements of that name, or an attribute, child or text that is there or is compared."""

    place: int | None = None  # from 0, or from -1 for the last
    subject: str = ""  # @attribute, child, or _VALUE for the element's own text
    operator: str = ""  # "", = or !=
    value: str = ""


@dataclass(frozen=True)
class _Step:
    name: str
    tests: tuple[_Test, ...]


_STEP = re.compile(r"""(?P<name>[^/\[\]@*]+)(?P<tests>(?:\[(?:[^\]'"]|'[^']*'|"[^"]*")*\])*)(?:/|$)""")
_TEST = re.compile(r"""\[\s*(?:(?P<place>\d+)|last\(\)\s*(?:-\s*(?P<back>\d+))?|(?P<subject>@?[^\s=!'"\[\]@/()]+)
 (?:\s*(?P<operator>=|!=)\s*(?P<quote>['"])(?P<value>.*?)(?P=quote))?)\s*\]""", re.VERBOSE | re.DOTALL)


def _row_steps(xpath: str) -> list[_Step]:
    """The steps of a path to row elements, with their predicates."""
    rest = re.sub(r"^(?:\.?//|\./|/)", "", xpath.strip())
    steps, at = [], 0
    while at < len(rest):
        found = _STEP.match(rest, at)
        if found is None or found["name"].strip() in ("", ".", ".."):
            raise ValueError(f"cannot read rows at {xpath!r}: steps are element names with predicates")
        tests, end = [], 0
        for test in _TEST.finditer(found["tests"]):
            if test.start() != end:
                break
            end = test.end()
            if test["subject"]:
                name = "_VALUE" if test["subject"] == "." else test["subject"]
                attribute = "@" if name.startswith("@") else ""
                tests.append(_Test(None, attribute + name.lstrip("@").rsplit(":", 1)[-1], test["operator"] or "", test["value"] or ""))
            elif test["place"]:
                tests.append(_Test(int(test["place"]) - 1))
            else:
                tests.append(_Test(-1 - int(test["back"] or 0)))
        if end != len(found["tests"]):
            raise ValueError(f"unknown predicate in {xpath!r}: {found['tests'][end:]}")
        steps.append(_Step(found["name"].strip().rsplit(":", 1)[-1], tuple(tests)))
        at = found.end()
    if not steps or rest.endswith("/"):
        raise ValueError(f"no row element in {xpath!r}")
    if any(t.place is not None for t in steps[0].tests):
        raise ValueError(f"the outermost element of {xpath!r} has no place: its neighbours are other rows")
    return steps


def _holds(test: _Test, row: Column, shape: T.StructType) -> Column:
    """Whether an element passes a predicate that looks into it."""
    if test.subject.startswith("@") or test.subject == "_VALUE":
        value = row["_" + test.subject[1:]] if test.subject.startswith("@") else row["_VALUE"]
        return value.isNotNull() if not test.operator else F.coalesce(value == test.value if test.operator == "=" else value != test.value, F.lit(False))
    children, inner = row[test.subject], shape[test.subject].dataType.elementType
    if not test.operator:
        return F.coalesce(F.size(children) > 0, F.lit(False))

    def compared(child: Column) -> Column:
        text = F.coalesce(child["_VALUE"] if isinstance(inner, T.StructType) else child, F.lit(""))
        return text == test.value if test.operator == "=" else text != test.value

    return F.coalesce(F.exists(children, compared), F.lit(False))


def _nest(paths: Sequence[list[str]]) -> T.StructType:
    """The row type that holds all paths; every element may repeat, so all elements are lists."""
    fields = []
    for head in dict.fromkeys(p[0] for p in paths):
        if head == "_VALUE":
            fields.append(T.StructField("_VALUE", T.StringType()))
            continue
        if head.startswith("@"):
            fields.append(T.StructField("_" + head[1:], T.StringType()))
            continue
        below = [p[1:] for p in paths if p[0] == head and len(p) > 1]
        inner = T.StringType()
        if below:
            inner = _nest(below)
            if [head] in paths and "_VALUE" not in inner.fieldNames():  # text and attributes or children of one element
                inner = T.StructType([*inner.fields, T.StructField("_VALUE", T.StringType())])
        fields.append(T.StructField(head, T.ArrayType(inner)))
    return T.StructType(fields)


def _first(steps: list[str], row: T.StructType) -> Column:
    """The first element on the path, over all its parents."""
    if steps[0].startswith("@"):
        return named("_" + steps[0][1:])
    if steps[0] == "_VALUE":
        return named("_VALUE")
    value, inner = named(steps[0]), row[steps[0]].dataType.elementType
    for step in steps[1:]:
        if step.startswith("@"):
            return F.get(_attributes(steps), 0)
        value = F.flatten(F.filter(F.transform(value, field(step)), lambda e: e.isNotNull()))
        inner = inner[step].dataType.elementType
    if isinstance(inner, T.StructType):
        value = F.transform(value, field("_VALUE"))
    return F.get(value, 0)


def _attributes(steps: list[str]) -> Column:
    """All attributes on the path, over all elements; null where there is no element."""
    *elements, last = steps
    if not elements:
        return F.when(named("_" + last[1:]).isNotNull(), F.array(named("_" + last[1:])))
    value = named(elements[0])
    for step in elements[1:]:
        value = F.flatten(F.filter(F.transform(value, field(step)), lambda e: e.isNotNull()))
    return F.filter(F.transform(value, field("_" + last[1:])), lambda e: e.isNotNull())


def read_xml(
    spark: SparkSession,
    path: str,
    files: str | Sequence[str] | None = None,
    *,
    row_xpath: str,
    fields: Mapping[str, str],
    recursive: bool = False,
    file_column: str | None = None,
) -> DataFrame:
    """One row per element that ``row_xpath`` names, one string column per ``{column: relative path}``.

    ``row_xpath`` is a path of element names with predicates ``[n]``, ``[last()]``, ``[@a]``, ``[@a='v']``, ``[b]``, ``[b='v']`` and
    ``[.='v']`` (and ``!=``). Its first element is found at any depth, so that a file is read in parallel; the others are children
    of it. Any other path is an error. A field is ``.``, ``@attribute``, ``a/b`` or ``a/b/text()``. Text is stripped, blank text is
    null, and no schema inference runs.
    """
    paths = require_paths(spark, path, files, "*.xml", recursive)
    wanted = {column: _steps(xpath) for column, xpath in fields.items()}
    steps = _row_steps(row_xpath)
    shapes, below = [], list(wanted.values())  # the type of each step's element, from the innermost
    for depth in range(len(steps) - 1, -1, -1):
        below = below + [[t.subject] for t in steps[depth].tests if t.subject]
        shapes.insert(0, _nest(below))
        below = [[steps[depth].name, *p] for p in below]
    rows = spark.read.format("xml").option("rowTag", steps[0].name).option("ignoreNamespace", True).schema(shapes[0]).load(paths)
    row = F.struct(*[named(f) for f in shapes[0].fieldNames()])
    rows = rows.select(row.alias("__row"), *([file_path().alias("__file")] if file_column else []))
    rest = ["__file"] if file_column else []
    for depth, step in enumerate(steps):
        if depth:
            inside = F.col("__row")[step.name]
            rows = rows.select(F.size(inside).alias("__size"), F.posexplode(inside).alias("__at", "__row"), *rest)
        for test in step.tests:
            if test.place is None:
                rows = rows.where(_holds(test, F.col("__row"), shapes[depth]))
            else:
                rows = rows.where(F.col("__at") == (test.place if test.place >= 0 else F.col("__size") + test.place))
    cells = [_blank_to_null(_first(path, shapes[-1])).alias(column) for column, path in wanted.items()]
    flat = rows.select("__row.*", *rest)
    return flat.select(*cells, *([F.col("__file").alias(file_column)] if file_column else []))


_COUNT = re.compile(r"count\((.*/)?@[^/]+\)")


def xml_fields(df: DataFrame, column: str, fields: Mapping[str, str], keep: Sequence[str] = (), shared: bool = False) -> DataFrame:
    """Fields of the XML element in a text column, by the relative paths of ``read_xml``; each text is parsed once. ``count(a/@b)`` is the
    number of such attributes.

    ``shared``: many texts hold the same elements, as the documents of ``nest_between`` do. A task then parses an element when it
    first meets it and remembers what it holds. All fields are attributes or their counts then.
    """
    counts = {name for name, xpath in fields.items() if _COUNT.fullmatch(xpath)}
    wanted = {name: _steps(xpath[len("count("):-1] if name in counts else xpath) for name, xpath in fields.items()}
    if shared and not all(steps[-1].startswith("@") for steps in wanted.values()):
        raise ValueError("shared elements are read for attributes only")
    shape = _nest(list(wanted.values()))
    kept = [named(k).alias(f"__keep_{i}") for i, k in enumerate(keep)]
    text = named(column)
    if shared:
        df = df.select(*kept, text.alias("__text"), _remembering(wanted, counts)(text).alias("__known"))
        kept, text = [F.col(f"__keep_{i}") for i in range(len(keep))], F.when(~F.col("__known.plain"), F.col("__text"))
    parsed = F.from_xml(text, _ddl(shape), {"ignoreNamespace": "true"})
    rows = df.select(*kept, *(["__known"] if shared else []), parsed.alias("__row")).select(
        *[F.col(f"__keep_{i}") for i in range(len(keep))], *(["__known"] if shared else []), F.col("__row").isNotNull().alias("__parsed"), "__row.*")
    cells = []
    for i, (name, steps) in enumerate(wanted.items()):
        if name in counts:
            cell = F.when(F.col("__parsed"), F.coalesce(F.array_size(_attributes(steps)), F.lit(0)).cast("long"))
        else:
            cell = _first(steps, shape)
        cell = F.when(F.col("__known.plain"), F.col(f"__known.f{i}")).otherwise(cell) if shared else cell
        cells.append((cell if name in counts else _blank_to_null(cell)).alias(name))
    return rows.select(*[F.col(f"__keep_{i}").alias(k) for i, k in enumerate(keep)], *cells)


class _NotPlain(Exception):
    """A text that is left to Spark's parser: broken, or with names or parts on which parsers differ."""


REMEMBERED = 64_000_000  # bytes of elements that a task remembers
_Path = tuple[list[str], bool]  # steps to an attribute, whether it is counted


class _Attributes:
    """The first attribute or the number of attributes on each path, in texts of which many hold the same elements.

    Reads plain texts only; what parsers differ on, and any error, is for Spark's parser.
    """

    def __init__(self, paths: Sequence[_Path]) -> None:
        self.empty = [0 if counted else None for _, counted in paths]
        self.counted = [counted for _, counted in paths]
        self.below: dict = {}  # by name what is below: elements, and for an attribute its paths
        for i, (steps, _) in enumerate(paths):
            here = self.below
            for step in steps[:-1]:
                here = here.setdefault(step, {})
            here.setdefault(steps[-1], []).append(i)
        self.steps = {step.lstrip("@") for steps, _ in paths for step in steps}
        self.names: set[str] = set()
        self.known: dict[bytes, list | None] = {}
        self.size = 0

    def _named(self, name: str) -> None:
        """Names that are like one of a path, or may be, but are not it, are not plain."""
        if not name.isascii() or ":" in name or name == "xmlns" or len(name) > 900 or (
                name not in self.steps and name.lower() in {step.lower() for step in self.steps}):
            raise _NotPlain
        if len(self.names) < 10_000:
            self.names.add(name)

    def element(self, text: bytes, below: dict) -> list | None:
        """Of a text of one element; ``below`` is what is wanted inside and of it."""
        if not text.startswith(b"<") or b"<!" in text or b"<?" in text:
            return None
        found, names, counted, inside = self.empty.copy(), self.names, self.counted, [below]

        def begin(name: str, attributes: dict[str, str]) -> None:
            if name not in names:
                self._named(name)
            here = inside[-1].get(name, {})
            inside.append(here)
            for a, value in attributes.items():
                if a not in names:
                    self._named(a)
                for i in here.get("@" + a, ()):
                    if counted[i]:
                        found[i] += 1
                    elif found[i] is None:
                        found[i] = value
            if len(inside) > 100 or len(attributes) > 100:
                raise _NotPlain

        def end(_: str) -> None:
            inside.pop()

        parser = expat.ParserCreate("utf-8")
        parser.StartElementHandler, parser.EndElementHandler = begin, end
        try:
            parser.Parse(text, True)
        except (expat.ExpatError, _NotPlain):
            return None
        return found

    def child(self, text: bytes) -> list | None:
        """Of a child of the root, without its first sign."""
        got = self.known.get(text, self)
        if got is self:
            self.size += len(text) + 500
            if self.size > REMEMBERED:
                self.known, self.size = {}, len(text) + 500
            got = self.known[text] = self.element(b"<" + text, self.below)
        return got

    def document(self, text: bytes) -> list | None:
        """Of a whole text, or None if it is not plain. An indented document is a root with elements between line breaks: when the root
        without them and each of them alone are well-formed, the whole is, and it holds what they hold."""
        head, *cuts = text.split(b"\n    <")
        children: list[bytes] = []
        for cut in cuts:
            if cut.startswith(b"/") and children:
                children[-1] += b"\n    <" + cut
            else:
                children.append(cut)
        name, _, _ = head[1:].partition(b">")[0].partition(b" ")
        tail = b"\n</" + name + b">"
        if not children or not children[-1].endswith(tail):
            return self.element(text, _Root(self.below))
        children[-1] = children[-1][:-len(tail)]
        found = self.element(head + tail, _Root(self.below))
        for child in children:
            more = self.child(child)
            if found is None or more is None:
                return None
            found = [a + b if counted else b if a is None else a for a, b, counted in zip(found, more, self.counted)]
        return found


class _Root(dict):
    """What is wanted above a root of any name."""

    def __init__(self, below: dict) -> None:
        self.below = below

    def get(self, name: str, default: object = None) -> dict:
        return self.below


def _remembering(wanted: Mapping[str, list[str]], counts: set[str]):
    """Reads attributes of texts: ``plain``, and for plain texts a field f0, f1, ... for each path."""
    paths = [(steps, name in counts) for name, steps in wanted.items()]
    kinds = [("long", pa.int64()) if counted else ("string", pa.string()) for _, counted in paths]
    shape = ", ".join(["plain: boolean", *(f"f{i}: {kind}" for i, (kind, _) in enumerate(kinds))])

    @F.arrow_udf(f"struct<{shape}>")
    def read(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = _Attributes(paths)
        for column in columns:
            rows = [reader.document(text.as_buffer().to_pybytes()) if text.is_valid else None for text in column]
            plain = [r is not None for r in rows]
            cells = [pa.array([r and r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)]
            yield pa.StructArray.from_arrays([pa.array(plain, pa.bool_()), *cells], names=["plain", *(f"f{i}" for i in range(len(kinds)))])

    return read


def _ddl(shape: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape.fields)


class _Tables(HTMLParser):
    """Cells of all tables of a page, in the order the tables begin. A cell's text includes that of inner tables."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.open: list[tuple[list[list[str]], list[str] | None]] = []  # rows and text of the open cell, innermost last

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self.tables.append([])
            self.open.append((self.tables[-1], None))
        elif self.open and tag in ("tr", "td", "th"):
            self._close_cell()
            rows, _ = self.open[-1]
            if tag == "tr" or not rows:
                rows.append([])
            if tag != "tr":
                self.open[-1] = (rows, [])

    def handle_endtag(self, tag: str) -> None:
        if self.open and tag in ("table", "tr", "td", "th"):
            self._close_cell()
            if tag == "table":
                self.open.pop()

    def handle_data(self, data: str) -> None:
        for _, text in self.open:
            if text is not None:
                text.append(data)

    def close(self) -> None:
        super().close()
        while self.open:
            self._close_cell()
            self.open.pop()

    def _close_cell(self) -> None:
        rows, text = self.open[-1]
        if text is not None:
            rows[-1].append(" ".join("".join(text).split()))
            self.open[-1] = (rows, None)


def _first_table(html: str) -> int:
    """Where the first table begins, or 0 when that may be inside a comment or a script."""
    lower = html.lower()
    at = lower.find("<table")
    pairs = (("<!--", "-->"), ("<script", "</script"), ("<style", "</style"))
    return at if all(lower.count(a, 0, at) == lower.count(b, 0, at) for a, b in pairs) else 0


class HtmlTable:
    """Table function: rows of the n-th table whose text matches; nothing when the page has no such table."""

    def eval(self, html: str, table_index: int, match: str):
        if html is None or "<table" not in html.lower():
            return
        parser = _Tables()
        parser.feed(html[_first_table(html):])
        parser.close()
        found = [t for t in parser.tables if not match or any(re.search(match, c) for row in t for c in row)]
        if table_index < len(found):
            rows = [row for row in found[table_index] if row]
            for number, cells in enumerate(rows):
                yield number, cells


def html_tables(df: DataFrame, html: str, keep: Sequence[str], table_index: int = 0, match: str | None = None) -> DataFrame:
    """Rows (``row_no`` from 0, ``cells``) of one table of each page; the header is row 0 when the table has one."""
    spark = df.sparkSession
    spark.udtf.register("tablemill_html_table", F.udtf(HtmlTable, returnType="row_no int, cells array<string>", useArrow=True))
    kept = ", ".join(f"p.`{k}`" for k in keep)
    return spark.sql(
        f"SELECT {kept}, t.row_no, t.cells FROM {{pages}} p, "
        f"LATERAL tablemill_html_table(p.`{html}`, :table_index, :match) t",
        args={"table_index": table_index, "match": match or ""},
        pages=df.select(*[named(c) for c in dict.fromkeys([*keep, html])]),
    )


def read_html(spark: SparkSession, path: str, files: str | Sequence[str] | None = None, *, table_index: int = 0,
              match: str | None = None, recursive: bool = False) -> DataFrame:
    """One table of each HTML file."""
    paths = require_paths(spark, path, files, "*.html", recursive)
    pages = spark.read.text(paths, wholetext=True).select("value", file_path().alias("_file"))
    return html_tables(pages, "value", ["_file"], table_index, match)
