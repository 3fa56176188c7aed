"""Loading: model files to entity tables, references resolved by joins, problems as rows of a violations table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IllegalOperation, XmlError, of_violation
from ..functions.numeric import OPERATORS
from ..operators import ccf, elements, externs, formulas, graphs, references, substitutions
from ..settings import Settings
from ..sources import casts, paths, xml_nodes
from ..sources.xml_nodes import attr
from . import trees

EVENTS = {"define-gate": "gate", "define-basic-event": "basic-event", "define-house-event": "house-event"}
ARGUMENTS = ("event", "gate", "basic-event", "house-event")
LEAVES = ("int", "float", "bool", "pi", "parameter", "system-mission-time", "test-initiating-event", "test-functional-event", "extern-function")
LAWS = ("exponential", "GLM", "Weibull", "periodic-test")
DEVIATES = ("uniform-deviate", "normal-deviate", "lognormal-deviate", "gamma-deviate", "beta-deviate", "histogram")
KNOWN_OPERATORS = (*LEAVES, *OPERATORS, *LAWS, *DEVIATES)
CCF_LEAST = {"beta-factor": 0, "MGL": 2, "alpha-factor": 1, "phi-factor": 1}  # 0: the number of members
#: Least and most arguments of the operators that are no numeric ones.
ARITY = {"exponential": (2, 2), "GLM": (4, 4), "Weibull": (4, 4), "periodic-test": (4, 11), "uniform-deviate": (2, 2), "normal-deviate": (2, 2), "lognormal-deviate": (2, 3), "gamma-deviate": (2, 2), "beta-deviate": (2, 2), "histogram": (2, None)}

CCF_LEVELS = "group_id string, model string, n int, min_level int, level int, key string"
CCF_EVENTS = "group_id string, level int, id string, members array<string>"
SUBSTITUTIONS = "file string, line int, name string, type string, connective string, min_num int, hypothesis array<string>, source array<string>, target_event string, target_const boolean, complemented boolean, other_kinds boolean"


@dataclass
class Model:
    """Entity tables by name, ``violations`` among them; those that are functions yet are made on first use."""

    name: str
    tables: dict[str, DataFrame | Callable[[], DataFrame]]
    settings: Settings
    functions: externs.Registry = field(default_factory=externs.Registry)
    #: Makes the event-tree tables of a model without any: planned on first use only.
    absent: Callable[[], dict[str, DataFrame]] = dict
    #: Makes the events of common-cause groups, as many as there are combinations of members: of the groups (group_id) given, or of all.
    combined: Callable[[DataFrame | None], DataFrame] | None = None

    def __getattr__(self, name: str) -> DataFrame:
        tables = self.__dict__.get("tables", {})
        if name not in tables and name in trees.TABLES:
            tables |= self.absent()
        if name == "ccf_events" and name not in tables:
            tables[name] = self.combined(None)
        if name not in tables:
            raise AttributeError(name)
        if not isinstance(tables[name], DataFrame):
            tables[name] = tables[name]()
        return tables[name]


def factor_id() -> Column:
    return F.concat(F.lit("factor:"), "file", F.lit("#"), "node")


#: Sections whose nodes, but for definitions in other ones, are no parts of event trees or alignments.
_NO_TREES = ("define-gate", "define-basic-event", "define-house-event", "define-parameter", "define-substitution", "define-CCF-group")


class Loader:
    """The node table taken apart: one method a kind of construct."""

    def __init__(self, nodes: DataFrame):
        self.nodes = nodes.where((F.col("section") != "described") & (F.col("tag") != "#error"))
        self.all = nodes

    def tagged(self, *tags: str) -> DataFrame:
        rows = self.nodes
        if all(t in xml_nodes.SECTIONS for t in tags):  # only the parts of the table that hold them are read
            rows = rows.where(F.col("section").isin(*tags))
        return rows.where(F.col("tag").isin(*tags))

    def within(self, *sections: str) -> DataFrame:
        """What is in definitions of these kinds, other definitions inside left out, and the definitions."""
        return self.nodes.where(F.col("section").isin(*sections))

    def defined_id(self) -> Column:
        """The id of a node's definition."""
        role = elements.inherited_role(F.coalesce("def_role", F.lit("")), F.nullif(F.col("base_role"), F.lit("")))
        return elements.element_id(role, F.col("base_path"), casts.trim(F.coalesce("def_name", F.lit(""))))

    def named(self, *tags: str) -> DataFrame:
        """Definitions with name, role, paths and id."""
        role = elements.inherited_role(attr("role"), F.nullif(F.col("base_role"), F.lit("")))
        rows = self.tagged(*tags).withColumns({"name": casts.trim(attr("name")), "role": role})
        return rows.withColumns({"full_path": elements.full_path(F.col("base_path"), F.col("name")), "id": elements.element_id(F.col("role"), F.col("base_path"), F.col("name"))})

    def kids(self, parents: DataFrame, *keep: str, among: DataFrame | None = None) -> DataFrame:
        """Children of rows (file, node), with the parent's columns ``keep``; only those of ``among``, if given."""
        up = parents.select(F.col("file").alias("_f"), F.col("node").alias("_n"), *[F.col(c).alias(f"_{c}") for c in keep])
        rows = (self.nodes if among is None else among).join(up, (F.col("file") == F.col("_f")) & (F.col("parent") == F.col("_n"))).drop("_f")
        for c in keep:
            rows = rows.withColumnRenamed(f"_{c}", f"of_{c}")
        return rows.withColumnRenamed("_n", "of")

    def of_trees(self) -> DataFrame:
        """The nodes of event trees, alignments and all else that is in no definition of an event, parameter, group or substitution."""
        return self.nodes.where(~F.col("section").isin(*_NO_TREES) | (F.col("definition").isNotNull() & F.col("tag").startswith("define-")))

    def events(self) -> DataFrame:
        kind = F.element_at(F.create_map(*[F.lit(x) for kv in EVENTS.items() for x in kv]), F.col("tag"))
        return self.named(*EVENTS).withColumn("kind", kind)

    def ccf_members(self) -> DataFrame:
        groups = self.named("define-CCF-group")
        inside = self.within("define-CCF-group")
        lists = self.kids(groups, "id", "role", "base_path", among=inside).where("tag = 'members'")
        rows = self.kids(lists, "of_id", "of_role", "of_base_path", among=inside).where("tag = 'basic-event'").withColumn("name", casts.trim(attr("name")))
        rows = rows.select("file", "line", F.col("of_of_id").alias("group_id"), F.col("place").alias("ordinal"), "name", F.col("of_of_role").alias("role"), F.col("of_of_base_path").alias("base_path"))
        return rows.withColumn("event_id", elements.element_id(F.col("role"), F.col("base_path"), F.col("name")))

    def formulas_in(self, way: str, of: Column, base_path: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
        """``formulas`` of the first children of ``way``, tags from a definition down, by what the nodes tell of their ways: no join."""
        depth, tags = way.count("/"), F.split("up", "/")
        rows = self.within(way.partition("/")[0]).where((F.col("up") == way) | F.col("up").startswith(f"{way}/"))
        single, under = F.col("tag").isin(*ARGUMENTS, "constant"), F.get(tags, F.lit(depth + 1))
        rows = rows.withColumns({"far": F.size("places") - depth, "first": F.get("places", F.lit(depth)), "under": under, "complement": F.get(tags, F.lit(depth + 2)) == "not"})
        is_top = (F.col("far") == 0) & (F.col("place") == 0)
        gates = rows.where(is_top).select("file", "line", of.alias("id"), F.when(single, "null").otherwise(F.col("tag")).alias("connective"),
                                          casts.to_int(F.nullif(attr("min"), F.lit(""))).alias("min_num"), casts.to_int(F.nullif(attr("max"), F.lit(""))).alias("max_num"))
        held = (F.col("first") == 0) & ~under.isin(*ARGUMENTS, "constant")
        rows = rows.where((is_top & single) | ((F.col("far") == 1) & held & (F.col("tag") != "not")) | ((F.col("far") == 2) & held & F.col("complement")))
        ordinal = F.when(F.col("far") == 0, 0).when(F.col("far") == 1, F.col("place")).otherwise(F.get("places", F.lit(depth + 1)))
        args = rows.select("file", "line", "node", of.alias("gate_id"), base_path.alias("base_path"), ordinal.cast("int").alias("ordinal"), "tag", "attrs", (F.col("far") == 2).alias("complement"))
        return gates, *self._arguments(args)

    def formulas(self, defined: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(gates, gate_args, nested) of the formulas that are the first children of rows (file, node, id, base_path):
        formulas are flat; anything deeper goes to ``nested``."""
        top = self.kids(defined, "id", "base_path").where("place = 0")
        single = F.col("tag").isin(*ARGUMENTS, "constant")
        gates = top.select("file", "line", F.col("of_id").alias("id"), F.when(single, "null").otherwise(F.col("tag")).alias("connective"),
                           casts.to_int(F.nullif(attr("min"), F.lit(""))).alias("min_num"), casts.to_int(F.nullif(attr("max"), F.lit(""))).alias("max_num"))
        alone = top.where(single).select("file", "line", "node", F.col("of_id").alias("gate_id"), F.col("of_base_path").alias("base_path"), F.lit(0).alias("ordinal"), "tag", "attrs")
        below = self.kids(top.where(~single), "of_id", "of_base_path").select("file", "line", "node", F.col("of_of_id").alias("gate_id"), F.col("of_of_base_path").alias("base_path"), F.col("place").alias("ordinal"), "tag", "attrs")
        direct = alone.unionByName(below)
        plain = direct.where(F.col("tag") != "not").withColumn("complement", F.lit(False))
        inner = self.kids(direct.where("tag = 'not'"), "gate_id", "base_path", "ordinal")
        inner = inner.select("file", "line", "node", F.col("of_gate_id").alias("gate_id"), F.col("of_base_path").alias("base_path"), F.col("of_ordinal").alias("ordinal"), "tag", "attrs", F.lit(True).alias("complement"))
        return gates, *self._arguments(plain.unionByName(inner))

    def _arguments(self, args: DataFrame) -> tuple[DataFrame, DataFrame]:
        usable = F.col("tag").isin(*ARGUMENTS, "constant")
        nested = args.where(~usable).select("file", "line", "gate_id", "tag")
        state = casts.to_bool(attr("value"))
        args = args.where(usable).withColumns({
            "want": F.when(F.col("tag") == "constant", "constant").otherwise(F.coalesce(F.nullif(attr("type"), F.lit("")), F.col("tag"))),
            "ref": F.when(F.col("tag") == "constant", F.when(state, "__true__").otherwise("__false__")).otherwise(casts.trim(attr("name"))),
        })
        return args.drop("tag", "attrs"), nested

    def factors(self, groups: DataFrame) -> DataFrame:
        """Factors of common-cause groups (file, line, node, group_id, ordinal, level), in a list or not."""
        inside = self.within("define-CCF-group")
        direct = self.kids(groups, "id", among=inside)
        listed = self.kids(direct.where("tag = 'factors'"), "of_id", among=inside).withColumnRenamed("of_of_id", "group_id")
        rows = direct.withColumnRenamed("of_id", "group_id").select("file", "line", "node", "group_id", "tag", "attrs").unionByName(listed.select("file", "line", "node", "group_id", "tag", "attrs"))
        return rows.where("tag = 'factor'").select("file", "line", "node", "group_id", F.col("node").alias("ordinal"), casts.to_int(F.nullif(attr("level"), F.lit(""))).alias("level"))

    def described(self) -> tuple[DataFrame, DataFrame]:
        """(labels, attributes) of elements: file, node, label; file, line, node, name, value, type."""
        described = self.all.where("section = 'described'")
        labels = described.where("tag = 'label'").select("file", F.col("parent").alias("node"), F.col("text").alias("label"))
        lists = described.where("tag = 'attributes'").select("file", F.col("node").alias("parent"), F.col("parent").alias("of"))
        each = described.where("tag = 'attribute'").join(lists, ["file", "parent"])
        return labels, each.select("file", "line", F.col("of").alias("node"), attr("name").alias("name"), attr("value").alias("value"), attr("type").alias("type"))

    def expressions(self, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(roots, nodes): the expression under each owner (file, node, id) in a common-cause group, basic event and parameter, and all nodes of expressions.

        Bins of histograms and cases of switches are pairs: their children stand in the place of the pair.
        """
        roots = self.kids(owners, "id", among=self.within("define-CCF-group")).where("place = 0").select("file", F.col("node").alias("root"), F.col("of_id").alias("id"))
        for tag, kind in (("define-basic-event", "event:"), ("define-parameter", "parameter:")):
            first = self.within(tag).where((F.col("up") == tag) & (F.col("place") == 0))
            roots = roots.unionByName(first.select("file", F.col("node").alias("root"), F.concat(F.lit(kind), self.defined_id()).alias("id")))
        inside = self.nodes.where(~F.col("section").isin("define-gate", "define-substitution") & F.col("definition").isNotNull() & F.col("tag").isin(*KNOWN_OPERATORS, "bin", "case"))
        value = F.when(F.col("tag") == "int", casts.to_int(attr("value")).cast("double")).when(F.col("tag") == "float", casts.to_double(attr("value")))
        value = value.when(F.col("tag") == "bool", casts.to_bool(attr("value")).cast("double")).when(F.col("tag") == "pi", F.pi())
        return roots, inside.select("file", "line", "node", "parent", "ordinal", "tag", value.alias("literal"), casts.trim(attr("name")).alias("ref"), attr("unit").alias("unit"), attr("state").alias("state"), "base_path", "definition")


def resolved_args(args: DataFrame, entities: DataFrame, present: set[str]) -> DataFrame:
    """Gate arguments with arg_id and arg_kind; typed references look among their kind only. ``present``: the tags that there are."""
    constants = args.where("want = 'constant'").withColumns({"arg_id": F.col("ref"), "arg_kind": F.lit("house-event")})
    parts = [constants]
    for want in ARGUMENTS:
        if "event" not in present and not present & {want}:  # an event may have any type; else the tag is what is wanted
            continue
        pool = entities if want == "event" else entities.where(F.col("kind") == want)
        parts.append(references.resolve(args.where(F.col("want") == want), pool).withColumnsRenamed({"id": "arg_id", "kind": "arg_kind"}))
    return elements.union(parts)


def _validated(nodes: DataFrame, validator) -> DataFrame | None:
    """What a validator turns down, as a table of file, line and detail; None if it says nothing of single lines."""
    if validator is None:
        return None
    if not callable(validator):
        raise XmlError(f"a validator is a function of the node table, not {type(validator).__name__}", "logic")
    found = validator(nodes)
    if found is False:
        raise XmlError("the validator turns the documents down", "validity")
    if isinstance(found, DataFrame):
        absent = {"file", "line", "detail"} - set(found.columns)
        if absent:
            raise XmlError(f"the validator's table has no column {', '.join(sorted(absent))}", "logic")
        return found.select("file", "line", "detail")
    return None


def load(spark: SparkSession, patterns: list[str], settings: Settings | None = None, strict: bool = False, allow_extern: bool = False, functions: dict | None = None, validator=None, check_values: bool = False) -> Model:
    """A model from files. With ``strict`` the first violation (by stage) is raised as its error.

    ``functions``: Python callables for external functions, by symbol, allowed only with ``allow_extern``. ``validator``
    is called with the node table before anything else; it may raise, or give False, or a table (file, line, detail) of what
    it turns down, whose rows become violations. ``check_values`` (with ``strict`` always) also
    evaluates all expressions and adds the violations of their domains.
    """
    settings = settings or Settings()
    files = paths.expand(spark, patterns)
    rounds = graphs.Rounds(spark)
    try:
        nodes = rounds.save(xml_nodes.read_nodes(spark, files), "section")
    except Exception as e:  # noqa: BLE001 - only failed reads are told apart, all else goes on unchanged
        if found := xml_nodes.read_problem(e):
            raise found from e
        raise
    turned_down = _validated(nodes, validator)
    present = {r[0] for r in nodes.where(F.col("tag").startswith("define-") | F.col("tag").isin("attributes", *ARGUMENTS)).select("tag").distinct().collect()}  # a few kinds
    if not allow_extern and present & {"define-extern-library", "define-extern-function"}:
        raise IllegalOperation("external libraries are not allowed")
    of, v = Loader(nodes), elements.violation
    members = of.ccf_members()
    parameters = of.named("define-parameter").withColumn("unit", F.coalesce(F.nullif(attr("unit"), F.lit("")), F.lit("unitless")))
    groups = of.named("define-CCF-group").withColumn("model", attr("model"))
    houses = of.named("define-house-event")
    states = of.kids(houses, "id", among=of.within("define-house-event")).where("tag = 'constant'").select(F.col("of_id").alias("id"), casts.to_bool(attr("value")).alias("state"))
    houses = houses.select("id").join(states, "id", "left").select("id", F.coalesce("state", F.lit(False)).alias("state"))
    containers = of.named("define-fault-tree", "define-component")
    labels, attributes = of.described()
    path = F.when(F.coalesce("base_path", F.lit("")) == "", F.col("name")).otherwise(F.concat_ws(".", "base_path", "name"))
    components = containers.select(path.alias("path"), F.nullif("base_path", F.lit("")).alias("parent_path"), "name", "role", (F.col("tag") == "define-fault-tree").alias("is_fault_tree"))
    initiating = of.tagged("define-initiating-event").select("file", "line", attr("name").alias("name"), F.nullif(attr("event-tree"), F.lit("")).alias("tree"))
    alignments = of.tagged("define-alignment").select("file", "node", attr("name").alias("name"))
    registry = externs.Registry(allow_extern)
    extern_problems = _externs(of, registry, functions or {}) if present & {"define-extern-library", "define-extern-function"} else []
    has_trees = bool(present & {"define-event-tree", "define-initiating-event", "define-sequence", "define-rule"})

    # what takes jobs is done when something needs it, and once
    @cache
    def entities() -> DataFrame:
        found = of.events().select("file", "line", "id", "name", "role", "base_path", "full_path", "kind")
        # members of groups are basic events, but not reachable by a path
        return rounds.save(found.unionByName(members.select("file", "line", F.col("event_id").alias("id"), "name", "role", "base_path", F.lit(None).cast("string").alias("full_path"), F.lit("basic-event").alias("kind"))))

    @cache
    def tree_nodes() -> Loader:
        return Loader(rounds.save(of.of_trees(), "section")) if has_trees or "define-alignment" in present else of

    @cache
    def formula_tables() -> tuple[DataFrame, DataFrame, DataFrame]:
        """(gates, args, nested)."""
        parts = of.formulas_in("define-gate", of.defined_id(), F.col("base_path"))
        if present & {"define-event-tree", "define-sequence", "define-rule"}:  # collected formulas are gates of their own
            inside = tree_nodes()
            collected = inside.tagged("collect-formula").select("file", "node", trees.formula_id().alias("id"), F.lit("").alias("base_path"))
            parts = [a.unionByName(b) for a, b in zip(parts, inside.formulas(collected), strict=True)]
        gates, raw_args, nested = parts
        return rounds.save(gates), rounds.save(resolved_args(raw_args, entities(), present)), nested

    @cache
    def group_parts() -> tuple[DataFrame, DataFrame]:
        """(distributions, factors)."""
        return of.kids(groups, "id", among=of.within("define-CCF-group")).where("tag = 'distribution'"), of.factors(groups)

    @cache
    def expression_tables() -> tuple[DataFrame, DataFrame]:
        """(roots, expressions), references to parameters resolved."""
        distributions, factors = group_parts()
        owned = [
            distributions.withColumn("id", F.concat(F.lit("group:"), "of_id")), factors.withColumn("id", factor_id()),
        ]
        roots, expressions = of.expressions(elements.union([t.select("file", "node", "id") for t in owned]))
        # every member of a group has the group's distribution as its expression
        shared = roots.where("id LIKE 'group:%'").select("file", "root", F.substring("id", 7, 1 << 20).alias("group_id")).join(members.select("group_id", "event_id"), "group_id")
        roots = rounds.save(roots.unionByName(shared.select("file", "root", F.concat(F.lit("event:"), "event_id").alias("id"))))
        refs = references.resolve(expressions.where("tag = 'parameter'"), parameters.select("id", "role", "base_path", "full_path", F.lit("gate").alias("kind"))).drop("kind").withColumnRenamed("id", "parameter_id")
        return roots, rounds.save(expressions.join(refs.select("file", "node", "parameter_id"), ["file", "node"], "left"))

    @cache
    def tree_tables() -> dict[str, DataFrame]:
        return rounds.save_all(trees.tables(tree_nodes()))

    @cache
    def phase_tables() -> tuple[DataFrame, DataFrame, DataFrame]:
        """(phases, house events named in them, these with the states)."""
        inside = tree_nodes()
        phases = inside.kids(alignments, "name").where("tag = 'define-phase'")
        phases = phases.select("file", "line", "node", F.col("of_name").alias("alignment"), attr("name").alias("phase"), casts.to_double(attr("time-fraction")).alias("fraction"))
        set_in_phase = inside.kids(phases, "alignment", "phase").where("tag = 'set-house-event'").select("file", "line", "node", F.col("of_alignment").alias("alignment"), F.col("of_phase").alias("phase"), attr("name").alias("house_event"))
        set_to = inside.kids(set_in_phase.select("file", "node")).where("tag = 'constant'").select("file", F.col("of").alias("node"), casts.to_bool(attr("value")).alias("state"))
        return phases, set_in_phase, set_in_phase.join(set_to, ["file", "node"], "left")

    @cache
    def group_tables() -> tuple[DataFrame, Callable[[DataFrame | None], DataFrame], list[DataFrame]]:
        """(levels, what makes the groups' events, problems)."""
        if "define-CCF-group" not in present:
            return spark.createDataFrame([], CCF_LEVELS), lambda _: spark.createDataFrame([], CCF_EVENTS), []
        wrong: list[DataFrame] = []
        return *_groups(groups, members, *group_parts(), expression_tables()[0], rounds, wrong), wrong

    @cache
    def substitution_tables() -> tuple[DataFrame, list[DataFrame]]:
        if "define-substitution" not in present:
            return spark.createDataFrame([], SUBSTITUTIONS), []
        wrong: list[DataFrame] = []
        return rounds.save(_substitutions(of, entities(), wrong, present)), wrong

    def gate_edges() -> DataFrame:
        return formula_tables()[1].where("arg_kind = 'gate'").select(F.col("gate_id").alias("a"), F.col("arg_id").alias("b"))

    def tops() -> DataFrame:
        tree_gates = of.named("define-gate").select(F.split("base_path", "\\.")[0].alias("tree"), F.col("id").alias("gate_id"))
        tree_args = formula_tables()[1].where("arg_kind = 'gate'").join(tree_gates, "gate_id").select("tree", "arg_id")
        return graphs.top_nodes(tree_gates.where("tree <> ''"), tree_args)

    def violations() -> DataFrame:
        problems = [v(nodes.where("tag = '#error'"), "1 parse", "XmlError", F.col("file"), F.col("text"), F.col("file"))]
        if turned_down is not None:
            problems.append(v(turned_down, "1 parse", "XmlError", F.col("file"), F.concat(F.lit("ValidityError: "), F.coalesce(F.col("detail"), F.lit(""))), F.col("file"), F.col("line")))
        problems.append(v(nodes.where(F.col("parent").isNull() & ~F.col("tag").isin("opsa-mef", "#error")), "1 parse", "ValidityError", F.col("tag"), "not a model file", F.col("file"), F.col("line")))

        # names, roles, ids
        named = elements.union([entities().select("file", "line", "id", "name", "role", "base_path"), *[t.select("file", "line", "id", "name", "role", "base_path") for t in (parameters, groups)]])
        problems += [
            v(named.where(elements.bad_name(F.col("name"))), "2 define", "ValidityError", F.col("id"), "name is empty or holds a point", F.col("file"), F.col("line")),
            v(named.where(elements.bad_role(F.col("role"), F.col("base_path")) & ~elements.bad_name(F.col("name"))), "2 define", "ValidityError", F.col("id"), "private element at model scope", F.col("file"), F.col("line")),
            v(elements.duplicates(entities(), "id"), "2 define", "DuplicateElementError", F.col("id"), "event defined more than once"),
            v(elements.duplicates(entities().where("base_path <> ''"), "base_path", "name"), "2 define", "DuplicateElementError", F.concat_ws(".", "base_path", "name"), "name used more than once in a component"),
            v(elements.duplicates(parameters, "id"), "2 define", "DuplicateElementError", F.col("id"), "parameter defined more than once"),
            v(elements.duplicates(groups, "id"), "2 define", "DuplicateElementError", F.col("id"), "group defined more than once"),
            v(elements.duplicates(components, "path"), "2 define", "DuplicateElementError", F.col("path"), "component defined more than once"),
        ]
        if "attributes" in present:
            problems.append(v(elements.duplicates(attributes, "file", "node", "name"), "2 define", "DuplicateElementError", F.col("name"), "attribute given twice", F.col("file")))
        problems += extern_problems

        # formulas
        gates, args, nested = formula_tables()
        counts = args.groupBy("gate_id").agg(F.count("*").alias("n"))
        shaped = gates.join(counts, gates["id"] == counts["gate_id"], "left").fillna(0, ["n"])
        shaped = shaped.withColumn("problem", formulas.arity_problem(F.col("connective"), F.col("n"), F.col("min_num"), F.col("max_num")))
        args_of = args.where("complement OR want = 'constant'").join(gates.select(F.col("id").alias("gate_id"), "connective"), "gate_id").withColumn("problem", formulas.nesting_problem(F.col("connective"), F.col("complement"), F.col("want") == "constant"))
        broken = nested.select(F.col("gate_id").alias("id")).distinct()
        problems += [
            v(args.where("arg_id IS NULL"), "2 define", "UndefinedElement", F.col("ref"), F.concat(F.lit("argument of gate "), F.col("gate_id")), F.col("file"), F.col("line")),
            v(nested, "2 define", "ValidityError", F.col("gate_id"), F.concat(F.lit("nested formula: "), F.col("tag")), F.col("file"), F.col("line")),
            v(formulas.duplicate_args(args.where("arg_id IS NOT NULL")), "2 define", "DuplicateElementError", F.col("gate_id"), F.concat(F.lit("argument given twice: "), F.col("arg_id"))),
            v(shaped.where("problem IS NOT NULL").join(broken, "id", "left_anti"), "2 define", "ValidityError", F.col("id"), F.col("problem"), F.col("file"), F.col("line")),
            v(args_of.where("problem IS NOT NULL"), "2 define", "LogicError", F.col("gate_id"), F.col("problem"), F.col("file"), F.col("line")),
        ]

        # expressions and their references
        roots, expressions = expression_tables()
        odd = of.within("define-basic-event", "define-parameter", "define-CCF-group").where(F.col("definition").isNotNull()).join(roots.select("file", F.col("root").alias("node")), ["file", "node"], "left_semi").where(~F.col("tag").isin(*KNOWN_OPERATORS))
        problems += [
            v(expressions.where("tag = 'parameter' AND parameter_id IS NULL"), "2 define", "UndefinedElement", F.col("ref"), "parameter is not defined", F.col("file"), F.col("line")),
            v(expressions.where("tag IN ('int', 'float', 'bool') AND literal IS NULL"), "2 define", "ValidityError", F.col("tag"), "not a number of this kind", F.col("file"), F.col("line")),
            v(references.unit_mismatch(expressions.where("tag = 'parameter'").select("file", "line", F.col("parameter_id").alias("ref"), "unit"), parameters.select("id", "unit")), "2 define", "ValidityError", F.col("ref"), "unit differs from the parameter's", F.col("file"), F.col("line")),
            v(odd, "2 define", "ValidityError", F.col("tag"), "unknown expression", F.col("file"), F.col("line")),
            v(_arity_problems(expressions, registry), "2 define", "ValidityError", F.coalesce(F.nullif("ref", F.lit("")), "tag"), "wrong number of arguments", F.col("file"), F.col("line")),
            v(expressions.where(F.col("tag") == "extern-function").where(~F.col("ref").isin(*registry.known)) if registry.known else expressions.where("tag = 'extern-function'"), "2 define", "UndefinedElement", F.col("ref"), "external function is not defined", F.col("file"), F.col("line")),
        ]
        if settings.probability_analysis:
            bare = of.named("define-basic-event").select("id", "file", "line").join(roots.select(F.substring("id", 7, 1 << 20).alias("id")), "id", "left_anti")
            problems.append(v(bare, "2 define", "ValidityError", F.col("id"), "no expression", F.col("file"), F.col("line")))

        # cycles
        in_parameter = parameters.select("file", F.col("node").alias("definition"), F.col("id").alias("a"))
        parameter_edges = expressions.where("parameter_id IS NOT NULL").join(in_parameter, ["file", "definition"]).select("a", F.col("parameter_id").alias("b"))
        problems += [v(graphs.some_cycles(e), "3 validate", "CycleError", F.col("path"), f"cycle among {what}") for what, e in (("gates", gate_edges()), ("parameters", parameter_edges))]

        # event trees, phases, groups, substitutions
        if has_trees:
            problems.extend(trees.problems(tree_tables(), initiating, houses.select("id")))
        if "define-alignment" in present:
            phases, set_in_phase, _ = phase_tables()
            problems += [
                v(elements.duplicates(alignments, "name"), "2 define", "DuplicateElementError", F.col("name"), "alignment defined more than once"),
                v(elements.duplicates(phases, "alignment", "phase"), "2 define", "DuplicateElementError", F.concat_ws(".", "alignment", "phase"), "phase defined more than once"),
                v(elements.undefined(set_in_phase, houses, "house_event", "id"), "2 define", "UndefinedElement", F.col("house_event"), "house event of a phase", F.col("file"), F.col("line")),
                v(substitutions.phase_problems(phases).where("problem IS NOT NULL"), "3 validate", "ValidityError", F.col("alignment"), F.col("problem")),
            ]
        problems += group_tables()[2]
        subs, wrong = substitution_tables()
        problems += wrong
        if "define-substitution" in present:
            problems += _substitution_problems(subs, members if "define-CCF-group" in present else None, settings)
        found = rounds.save(elements.union(problems))
        if strict or check_values:
            from . import evaluate

            return rounds.save(found.unionByName(evaluate.domain_violations(model)))
        return found

    tops_of_files = nodes.where(F.col("parent").isNull())
    name = tops_of_files.where(F.col("file") == F.lit(_first(tops_of_files, files))).select(attr("name")).first()
    tables = {
        "nodes": nodes, "tree_nodes": lambda: tree_nodes().nodes, "entities": entities, "gates": lambda: graphs.same_rows(formula_tables()[0].select("id", "connective", "min_num", "max_num"), formula_tables()[0]),
        "gate_args": lambda: graphs.same_rows(formula_tables()[1].select("gate_id", "ordinal", "arg_id", "arg_kind", "complement"), formula_tables()[1]),
        "basic_events": lambda: entities().where("kind = 'basic-event'").select("id", "name", "role", "base_path", "full_path"), "house_events": houses, "parameters": parameters.select("id", "unit"),
        "components": components, "expressions": lambda: expression_tables()[1], "expression_roots": lambda: expression_tables()[0], "ccf_groups": groups.select("id", "model", "base_path"), "ccf_members": members.select("group_id", "ordinal", "event_id"), "ccf_levels": lambda: group_tables()[0],
        "top_events": tops, "initiating_events": initiating, "phases": lambda: phase_tables()[0].drop("node"), "phase_house_events": lambda: phase_tables()[2].drop("node"), "gate_edges": gate_edges, "substitutions": lambda: substitution_tables()[0],
        "labels": labels, "attributes": attributes, "violations": violations,
    }
    if has_trees:
        tables |= {name: (lambda name=name: tree_tables()[name]) for name in trees.TABLES}
    model = Model((name[0] if name and name[0] else elements.DEFAULT_MODEL_NAME), tables, settings, registry, lambda: trees.tables(of), lambda which: group_tables()[1](which))
    if strict:
        first = model.violations.orderBy("stage", "file", "line").first()
        if first:
            raise of_violation(first["code"], first["entity"], first["detail"], f"{first['file']}:{first['line']}")
    elif check_values:
        model.violations  # noqa: B018 - expressions are evaluated now
    return model


def inherited_attributes(model: Model) -> DataFrame:
    """(file, node, name, value, type) of all definitions: their own attributes and those of what they stand in, the nearest first."""
    rounds = graphs.Rounds(model.nodes.sparkSession)
    own = rounds.save(model.attributes.select("file", F.col("node").alias("at"), "name", F.struct("value", "type").alias("given")))
    up = rounds.save(model.nodes.select("file", F.col("node").alias("at"), "parent"))
    front = rounds.save(model.nodes.where("tag LIKE 'define-%' OR parent IS NULL").select("file", "node", F.col("node").alias("at"), F.lit(0).alias("far")))
    found = front.join(own, ["file", "at"])
    while not graphs.empty(front):
        front = rounds.save(front.join(up, ["file", "at"]).where("parent IS NOT NULL").select("file", "node", F.col("parent").alias("at"), (F.col("far") + 1).alias("far")))
        found = found.unionByName(front.join(own, ["file", "at"]))
    return found.groupBy("file", "node", "name").agg(F.min_by("given", "far").alias("given")).select("file", "node", "name", "given.value", "given.type")


def component_contents(model: Model) -> DataFrame:
    """(path, kind, id): what each fault tree or component holds itself; a common-cause group comes with all its members."""
    events = model.entities.where("base_path <> ''").select(F.col("base_path").alias("path"), "kind", "id")
    groups = model.ccf_groups.where("base_path <> ''").select(F.col("base_path").alias("path"), F.lit("CCF-group").alias("kind"), "id")
    return events.unionByName(groups).join(model.components.select("path"), "path", "left_semi")


def _first(nodes: DataFrame, files: list[str]) -> str:
    """The first file as the node table spells it."""
    tail = files[0].split("://")[-1].lstrip("/")
    return next((r[0] for r in nodes.select("file").distinct().collect() if r[0].endswith(tail)), files[0])


def _arity_problems(expressions: DataFrame, registry: externs.Registry) -> DataFrame:
    """Expressions whose number of arguments is none that their operator takes."""
    bounds = {**{k: (least, most) for k, (least, most, _) in OPERATORS.items()}, **ARITY, **{f"extern-function {k}": (len(x.parameters),) * 2 for k, (_, x) in registry.known.items()}}
    bound = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in bounds.items() for x in (k, -1 if v[i] is None else v[i])]), F.when(F.col("tag") == "extern-function", F.concat_ws(" ", "tag", "ref")).otherwise(F.col("tag")))
    counts = expressions.groupBy("file", F.col("parent").alias("node")).agg(F.count("*").alias("n"))
    counted = expressions.where(~F.col("tag").isin("parameter", "and", "or", "not"))  # also connectives of collected formulas
    counted = counted.join(counts, ["file", "node"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "least": bound(0), "most": bound(1)})
    return counted.where("n < least OR (most >= 0 AND n > most) OR (tag = 'periodic-test' AND n BETWEEN 6 AND 10)")


def _externs(of: Loader, registry: externs.Registry, functions: dict) -> list[DataFrame]:
    """External functions go to the registry, as many as models declare; violations of their declarations."""
    v, at = elements.violation, (F.col("file"), F.col("line"))
    declared = of.tagged("define-extern-function").select("file", "line", "node", attr("name").alias("name"), attr("symbol").alias("symbol"), attr("library").alias("library"))
    kinds = of.kids(declared.select("file", "node")).groupBy("file", F.col("of").alias("node")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "tag"))), lambda x: x["tag"]).alias("kinds"))
    wrong = []
    for r in declared.join(kinds, ["file", "node"]).collect():
        try:
            registry.add(r["name"], functions.get(r["symbol"]), *r["kinds"])
        except RiskError as e:
            wrong.append(("2 define", e.code, r["name"], str(e), r["file"], r["line"]))
    libraries = of.tagged("define-extern-library").select(attr("name").alias("library"))
    return [
        of.nodes.sparkSession.createDataFrame(wrong, elements.VIOLATION),
        v(elements.undefined(declared, libraries, "library", "library"), "2 define", "UndefinedElement", F.col("library"), F.concat(F.lit("library of "), F.col("name")), *at),
        v(elements.duplicates(libraries, "library"), "2 define", "DuplicateElementError", F.col("library"), "library defined more than once"),
    ]


def _groups(groups: DataFrame, members: DataFrame, distributions: DataFrame, factors: DataFrame, roots: DataFrame, rounds: graphs.Rounds, problems: list[DataFrame]) -> tuple[DataFrame, Callable[[DataFrame | None], DataFrame]]:
    """Levels of common-cause groups, and what makes their events, their models applied; adds what is wrong with them to ``problems``."""
    v, at = elements.violation, (F.col("file"), F.col("line"))
    sizes = members.groupBy("group_id").agg(F.count("*").cast("int").alias("n"))
    plain = groups.select("id", "file", "line")
    small = plain.join(sizes.select(F.col("group_id").alias("id"), "n"), "id", "left").where("coalesce(n, 0) < 2")
    least = F.element_at(F.create_map(*[F.lit(x) for kv in CCF_LEAST.items() for x in kv]), F.col("model"))
    of_group = groups.select(F.col("id").alias("group_id"), "model", "role", "base_path").join(sizes, "group_id")
    levels = factors.join(of_group.select("group_id", "model", "n", F.when(least == 0, F.col("n")).otherwise(least).cast("int").alias("min_level")), "group_id")
    keyed = roots.select(F.col("id").alias("owner"), F.concat_ws("#", F.col("file").alias("f"), "root").alias("key"))
    levels = ccf.factor_levels(levels).withColumn("owner", factor_id()).join(keyed, "owner", "left").select("group_id", "model", "n", "min_level", "level", "key")
    levels = rounds.save(levels)
    without = plain.join(distributions.select(F.col("of_id").alias("id")), "id", "left_anti").unionByName(plain.join(factors.select(F.col("group_id").alias("id")), "id", "left_anti")).distinct()
    problems += [
        v(small, "2 define", "ValidityError", F.col("id"), "a group needs 2 or more members", *at),
        v(elements.duplicates(members, "group_id", "name"), "2 define", "DuplicateElementError", F.col("group_id"), "member given twice"),
        v(groups.where(~F.col("model").isin(*CCF_LEAST)), "2 define", "ValidityError", F.col("model"), "unknown common-cause model", *at),
        v(elements.duplicates(distributions, "of_id"), "2 define", "LogicError", F.col("of_id"), "distribution given twice"),
        v(without, "3 validate", "LogicError", F.col("id"), "a group needs a distribution and factors", *at),
        v(ccf.level_problems(levels), "2 define", "ValidityError", F.col("group_id"), F.col("problem")),
    ]

    def combined(which: DataFrame | None) -> DataFrame:
        some = lambda t: t if which is None else t.join(which, "group_id", "left_semi")
        return graphs.Rounds(groups.sparkSession).save(_ccf_events(some(levels), some(members), of_group))

    return levels, combined


def _substitution_problems(subs: DataFrame, members: DataFrame | None, settings: Settings) -> list[DataFrame]:
    """What is wrong with the substitutions; ``members`` of common-cause groups, if there are any."""
    v, at = elements.violation, (F.col("file"), F.col("line"))
    active = subs.where(~substitutions.declarative(F.col("source")))
    other = subs.where(substitutions.problem().isNull()).where((F.col("type") != "") & ~F.col("type").eqNullSafe(substitutions.kind()))
    found = [
        v(elements.duplicates(subs, "name"), "2 define", "DuplicateElementError", F.col("name"), "substitution defined more than once"),
        v(subs.withColumn("problem", substitutions.problem()).where("problem IS NOT NULL"), "2 define", "ValidityError", F.col("name"), F.col("problem"), *at),
        v(other, "2 define", "ValidityError", F.col("name"), "declared type is not the deduced one", *at),
        v(substitutions.conflicts(subs), "3 validate", "ValidityError", F.col("name"), F.concat("why", F.lit(": "), "event")),
    ]
    if members is not None:
        touched = active.select("name", F.explode(F.array_compact(F.concat("hypothesis", "source", F.array("target_event")))).alias("event_id"))
        found.append(v(touched.join(members.select("event_id"), "event_id", "left_semi").select("name").distinct(), "3 validate", "ValidityError", F.col("name"), "events of a non-declarative substitution in a common-cause group"))
    if settings.approximation == "none":
        found.append(v(active, "3 validate", "ValidityError", F.col("name"), "non-declarative substitutions need an approximation", *at))
    return found


def _ccf_events(levels: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, level, id, members): the events of all combinations that the groups' models have."""
    ones = levels.select("group_id", F.lit(1).alias("level")).distinct()
    wanted = levels.select("group_id", "level").unionByName(ones).distinct()
    rows = members.select("group_id", "ordinal", F.struct("name", F.col("event_id").alias("id")).alias("event_id"))
    found = ccf.combinations(rows, wanted.where("level >= 1")).join(groups.select("group_id", "role", "base_path"), "group_id")
    name = ccf.event_name(F.transform("members", lambda m: m["name"]))
    return found.select("group_id", "level", elements.element_id(F.col("role"), F.col("base_path"), name).alias("id"), F.transform("members", lambda m: m["id"]).alias("members"))


def _substitutions(of: Loader, entities: DataFrame, problems: list[DataFrame], present: set[str]) -> DataFrame:
    """The substitutions, as ``operators.substitutions`` takes them; adds what is wrong with their parts to ``problems``."""
    v, at = elements.violation, (F.col("file"), F.col("line"))
    defined = of.tagged("define-substitution").select("file", "line", "node", attr("name").alias("name"), attr("type").alias("type"))
    rounds, named, inside = graphs.Rounds(entities.sparkSession), F.coalesce("def_name", F.lit("")), of.within("define-substitution")
    forms, raw, nested = of.formulas_in("define-substitution/hypothesis", named, F.lit(""))
    forms, args = rounds.save(forms), rounds.save(resolved_args(raw, entities, present))
    basic = entities.where("kind = 'basic-event'")

    def events(tag: str) -> DataFrame:
        rows = inside.where((F.col("up") == f"define-substitution/{tag}") & (F.col("tag") == "basic-event"))
        found = rows.select("file", "line", named.alias("name"), "ordinal", casts.trim(attr("name")).alias("ref"), F.lit("").alias("base_path"))
        # each name is looked up once: very many substitutions may have the same target
        meant = references.resolve(found.select("base_path", "ref").distinct(), basic).select("ref", F.col("id").alias("event"))
        return rounds.save(found.join(meant, "ref", "left"))

    sources, targets = events("source"), events("target")
    constants = inside.where("up = 'define-substitution/target' AND tag = 'constant'").select(named.alias("name"), casts.to_bool(attr("value")).alias("target_const"))
    counts = args.groupBy("gate_id").agg(F.count("*").alias("n"), F.count("arg_id").alias("known"), F.sort_array(F.collect_set("arg_id")).alias("hypothesis"), F.bool_or("complement").alias("complemented"), F.bool_or(F.col("arg_kind") != "basic-event").alias("other_kinds"))
    shaped = forms.join(counts, forms["id"] == counts["gate_id"], "left").fillna(0, ["n"])
    shaped = rounds.save(shaped.withColumn("problem", formulas.arity_problem(F.col("connective"), F.col("n"), F.col("min_num"), F.col("max_num"))))
    # only hypotheses with fewer events than arguments can have one twice
    odd = rounds.save(shaped.where(F.col("known") > F.size("hypothesis")).select("gate_id"))
    repeated = args.where("arg_id IS NOT NULL AND false") if graphs.empty(odd) else graphs.only(args.where("arg_id IS NOT NULL"), odd, "gate_id")
    missing = [t.where(f"{c} IS NULL").select("ref", *("file", "line"), F.col(n).alias("of")) for t, c, n in ((args, "arg_id", "gate_id"), (sources, "event", "name"), (targets, "event", "name"))]
    problems += [
        v(elements.union(missing), "2 define", "UndefinedElement", F.col("ref"), F.concat(F.lit("event of substitution "), "of"), *at),
        v(shaped.where("problem IS NOT NULL"), "2 define", "ValidityError", F.col("id"), F.col("problem"), *at),
        v(nested, "2 define", "ValidityError", F.col("gate_id"), F.concat(F.lit("nested formula: "), F.col("tag")), *at),
        v(elements.duplicates(sources.where("event IS NOT NULL"), "name", "event"), "2 define", "DuplicateElementError", F.col("name"), F.concat(F.lit("source given twice: "), "event")),
        v(formulas.duplicate_args(repeated), "2 define", "DuplicateElementError", F.col("gate_id"), F.concat(F.lit("argument given twice: "), "arg_id")),
    ]
    rows = defined.join(shaped.select(F.col("id").alias("name"), "connective", "min_num", "hypothesis", "complemented", "other_kinds"), "name", "left")
    rows = rows.join(sources.groupBy("name").agg(F.sort_array(F.collect_set("event")).alias("source")), "name", "left")
    rows = rows.join(targets.groupBy("name").agg(F.first("event", ignorenulls=True).alias("target_event")), "name", "left").join(constants, "name", "left")
    none = F.array().cast("array<string>")
    return rows.select("file", "line", "name", "type", "connective", "min_num", F.coalesce("hypothesis", none).alias("hypothesis"), F.coalesce("source", none).alias("source"), "target_event", "target_const", F.coalesce("complemented", F.lit(False)).alias("complemented"), F.coalesce("other_kinds", F.lit(False)).alias("other_kinds"))
