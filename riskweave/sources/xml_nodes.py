"""Model files in XML as one table of element nodes, in document order.

Sibling order matters in model files, which Spark's own XML reader does not keep; so files are read as binary and
parsed in Python workers, file by file. Inclusions by XInclude are expanded from files read beforehand; nothing is
fetched from a network. A file that is not well-formed gives one row with the tag ``#error``.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import XmlError

SCHEMA = "file string, node int, parent int, ordinal int, tag string, attrs map<string,string>, text string, line int, base_path string, base_role string, definition int, owner int, place int, up string, places array<int>, def_name string, def_role string, def_type string, section string"
#: Bytes of included files, together, that are handed to every worker.
MAX_INCLUDED = 64 << 20
#: Tags of the ways from definitions to nodes (``up``), at most; nodes further down have none.
MAX_UP = 6
DESCRIBED = ("label", "attributes", "attribute")
#: Parts of the saved node table: what is in such a definition, or is one; all else is in ``other``, descriptions in ``described``.
SECTIONS = ("define-gate", "define-basic-event", "define-house-event", "define-parameter", "define-substitution", "define-CCF-group", "define-event-tree", "define-sequence", "define-rule", "define-branch", "define-initiating-event", "define-alignment", "define-phase")
_HREF = r"<[\w.-]*:?include\b[^>]*?\bhref\s*=\s*[\"']([^\"']+)[\"']"
_CONTAINERS = ("define-fault-tree", "define-component")
#: Elements whose children are instructions.
_OWNERS = ("initial-state", "define-branch", "path", "define-sequence", "define-rule", "define-phase")


def _resolve(file: str, href: str) -> str:
    return href if "://" in href or href.startswith("/") else posixpath.join(posixpath.dirname(file), href)


#: Name, role, type and section of the definition around what is in none.
_NOWHERE = (None, None, None, "other")


def _text(values: list) -> pa.Array:
    return pa.array(values, pa.string())


class _Tree:
    """Element nodes of one file, a list a column, each with the path and role of its containers, its definition and the owner of its instructions.

    ``place`` counts among siblings that are no descriptions; ``up`` are the tags from the definition down to the parent,
    ``places`` the places of those below the definition; ``def_...`` are attributes of the definition.
    """

    def __init__(self, file: str, included: dict[str, bytes]):
        self.file, self.included = file, included
        # parent, ordinal, tag, line, base_path, base_role, definition, owner, place, up, def_name, def_role, def_type, section
        self.columns: list[list] = [[] for _ in range(14)]
        self.keys: list[str] = []
        self.values: list[str] = []
        self.key_ends, self.places, self.place_ends = [0], [], [0]
        self.texts: dict[int, list[str]] = {}
        self.stack: list[tuple] = []  # node, [children so far, those that count], base_path, base_role, definition, owner, up, places, (name, role, type, section)
        self.open_files: list[str] = []
        self.kinds: dict[str, tuple] = {}

    def _kind(self, tag: str) -> tuple:
        """(includes, described, defines, container, owns instructions, section of what it defines) of a tag."""
        defines = tag.startswith("define-") and tag not in _CONTAINERS
        self.kinds[tag] = (tag.rpartition(":")[2] == "include", tag in DESCRIBED, defines, tag in _CONTAINERS, tag in _OWNERS, tag if tag in SECTIONS else "other")
        return self.kinds[tag]

    def parse(self, body: bytes, file: str) -> None:
        if file in self.open_files:
            raise XmlError(f"{file} includes itself", "xinclude")
        self.open_files.append(file)
        parser = expat.ParserCreate()
        parser.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_NEVER)
        stack, kinds, keys, values, key_ends, all_places, place_ends = self.stack, self.kinds, self.keys, self.values, self.key_ends, self.places, self.place_ends
        put = [c.append for c in self.columns]
        put_parent, put_ordinal, put_tag, put_line, put_base, put_role, put_definition, put_owner, put_place, put_up, put_name, put_def_role, put_type, put_section = put

        def start(tag: str, given: list) -> None:
            includes, described, defines, container, owns, section = kinds.get(tag) or self._kind(tag)
            attrs = dict(zip(given[::2], given[1::2], strict=True)) if defines or container or includes else {}
            if includes and "href" in attrs:
                target = _resolve(file, attrs["href"])
                if target not in self.included:
                    raise XmlError(f"cannot include {attrs['href']}", "xinclude")
                stack.append(None)
                self.parse(self.included[target], target)
                return
            top = (stack[-1] or next((s for s in reversed(stack) if s), None)) if stack else None
            node = len(place_ends) - 1
            if top:
                parent, count, base, role, definition, owner, up, places, of = top
                ordinal, place = count
                count[0] = ordinal + 1
                if not described:
                    count[1] = place + 1
            else:
                parent, ordinal, place, base, role, definition, owner, up, places, of = None, 0, 0, "", "", None, None, "", [], _NOWHERE
            inside = (attrs.get("name"), attrs.get("role"), attrs.get("type"), section) if defines else of
            put_parent(parent), put_ordinal(ordinal), put_tag(tag), put_line(parser.CurrentLineNumber), put_base(base), put_role(role), put_definition(definition), put_owner(owner), put_place(place), put_up(up)
            put_name(of[0]), put_def_role(of[1]), put_type(of[2]), put_section("described" if described else inside[3])
            keys.extend(given[::2])
            values.extend(given[1::2])
            key_ends.append(len(keys))
            all_places.extend(places)
            place_ends.append(len(all_places))
            if container:
                name = attrs.get("name", "")
                base, role = f"{base}.{name}" if base else name, attrs.get("role") or role or "public"
            if defines:
                definition, below, places = node, tag, []
            elif definition is None or up is None or len(places) + 2 > MAX_UP:
                below, places = "" if definition is None else None, []
            else:
                below, places = f"{up}/{tag}", [*places, place]
            if owns:
                owner = node
            stack.append((node, [0, 0], base, role, definition, owner, below, places, inside))

        def end(_: str) -> None:
            stack.pop()

        def text(data: str) -> None:
            if stack and stack[-1] and (stack[-1][0] in self.texts or not data.isspace()):
                self.texts.setdefault(stack[-1][0], []).append(data)

        parser.buffer_text = parser.ordered_attributes = True
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
        try:
            parser.Parse(body, True)
        except expat.ExpatError as e:
            raise XmlError(str(e), "parse") from e
        self.open_files.pop()

    def batch(self) -> pa.RecordBatch:
        """The nodes in the columns of ``SCHEMA``."""
        n, whole = len(self.place_ends) - 1, lambda values: pa.array(values, pa.int32())
        parent, ordinal, tag, line, base, role, definition, owner, place, up, name, def_role, kind, section = self.columns
        texts = [""] * n
        for node, data in self.texts.items():
            texts[node] = "".join(data).strip()
        attrs = pa.MapArray.from_arrays(whole(self.key_ends), _text(self.keys), _text(self.values))
        places = pa.ListArray.from_arrays(whole(self.place_ends), whole(self.places))
        columns = [
            pa.repeat(pa.scalar(self.file, pa.string()), n), whole(range(n)), whole(parent), whole(ordinal), _text(tag), attrs, _text(texts), whole(line), _text(base), _text(role),
            whole(definition), whole(owner), whole(place), _text(up), places, _text(name), _text(def_role), _text(kind), _text(section),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


def parse(file: str, body: bytes, included: dict[str, bytes]) -> pa.RecordBatch:
    """The nodes of one file, or the row that tells what is wrong with it."""
    tree = _Tree(file, included)
    try:
        tree.parse(body, file)
    except XmlError as e:
        tree = _Tree(file, included)
        for column, value in zip(tree.columns, (None, 0, "#error", None, "", "", None, None, 0, "", None, None, None, "other"), strict=True):
            column.append(value)
        tree.keys, tree.values, tree.key_ends, tree.place_ends, tree.texts = ["kind"], [e.kind], [0, 1], [0, 0], {0: [f"{e.keyword}: {e}"]}
    return tree.batch()


def read_problem(e: Exception) -> XmlError | None:
    """The error of a failed job if a file was there when paths were expanded and cannot be opened now; else None."""
    text = str(e)
    if any(x in text for x in ("FAILED_READ_FILE", "FileNotFoundException", "AccessControlException", "FILE_NOT_EXIST")):
        return XmlError(text.splitlines()[0], "io")
    return None


def _included(spark: SparkSession, files: list[str]) -> dict[str, bytes]:
    """All files that the files include, directly or not, by name."""
    have: dict[str, bytes] = {}
    front = files
    while front:
        # only files that speak of inclusions are looked through
        read = spark.read.format("binaryFile").load(front).select("path", "content").where(F.contains("content", F.lit(b"include")))
        hrefs = F.regexp_extract_all(F.decode("content", "ISO-8859-1"), F.lit(_HREF), F.lit(1))
        found = read.select("path", F.explode(hrefs).alias("href")).withColumn("href", F.decode(F.encode("href", "ISO-8859-1"), "UTF-8"))
        wanted = sorted({_resolve(r[0], r[1]) for r in found.select(F.regexp_replace("path", "[^/]*$", "").alias("folder"), "href").distinct().collect()} - set(have))
        present = []
        for name in wanted:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                present.append(name)
        front = present
        if present:
            rows = spark.read.format("binaryFile").load(present).select("path", "content").collect()
            have |= {name: bytes(r["content"]) for r in rows for name in present if r["path"].endswith(name.split("://")[-1])}
        if sum(map(len, have.values())) > MAX_INCLUDED:
            raise XmlError("included files are too large together", "xinclude")
    return have


def _emit(held):
    """From (path, content) batches to node batches; ``held`` broadcasts the included files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                nodes = parse(file, body, held.value)
                for low in range(0, nodes.num_rows, 10_000):
                    yield nodes.slice(low, 10_000)

    return run


def read_nodes(spark: SparkSession, files: list[str]) -> DataFrame:
    """The node table of some files, one task each."""
    held = spark.sparkContext.broadcast(_included(spark, files))  # bounded by MAX_INCLUDED
    return spark.read.format("binaryFile").load(files).select("path", "content").mapInArrow(_emit(held), SCHEMA)


def stream_nodes(spark: SparkSession, folder: str, pattern: str = "*.xml") -> DataFrame:
    """The node table of a folder as a stream: files that arrive are parsed once each. Inclusions are not expanded."""
    held = spark.sparkContext.broadcast({})
    schema = "path string, modificationTime timestamp, length long, content binary"
    source = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)
    return source.select("path", "content").mapInArrow(_emit(held), SCHEMA)


def attr(name: str) -> Column:
    """An attribute of a node; empty if it is not there."""
    return F.coalesce(F.col("attrs")[name], F.lit(""))


def children(nodes: DataFrame, parents: DataFrame, tag: str | None = None) -> DataFrame:
    """Child elements of (file, node) rows, in order, with the parent's node as ``of``; only of one tag if given."""
    kids = nodes if tag is None else nodes.where(F.col("tag") == tag)
    return kids.join(parents.select("file", F.col("node").alias("of")).distinct(), (kids["file"] == parents["file"]) & (kids["parent"] == F.col("of"))).drop(parents["file"])
