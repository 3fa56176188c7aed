"""Event trees from model files: branches, sequences, rules, instructions and links, their checks and the walk.

A unit is an element that holds instructions: the initial state or a named branch of a tree, a path of a fork, a
sequence, a rule. A block is what can be referred to: a tree (by its initial state), a named branch, a sequence or a
rule, with the paths inside it. All checks are joins over the table of references between blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import elements, eventtrees, graphs
from ..sources import casts
from ..sources.xml_nodes import attr

INSTRUCTIONS = ("rule", "event-tree", "collect-expression", "collect-formula", "if", "block", "set-house-event")
TARGETS = ("fork", "sequence", "branch")
TABLES = ("event_trees", "functional_events", "named_branches", "sequences", "rules", "branches", "instructions", "tree_references", "strange_instructions")


def _unit(node: str = "node") -> Column:
    return F.concat_ws("#", "file", node)


def formula_id() -> Column:
    """The gate that stands for a collected formula, by the row (file, node) of its instruction."""
    return F.concat(F.lit("formula:"), _unit())


def tables(of) -> dict[str, DataFrame]:
    """Tables of a ``model.Loader``: event_trees, functional_events, branches, sequences, rules, instructions, references."""
    trees = of.tagged("define-event-tree").select("file", "line", "node", attr("name").alias("tree"), F.concat(F.lit("t:"), attr("name")).alias("block"))
    in_tree = trees.select("file", F.col("node").alias("definition"), "tree")
    functional = of.kids(trees, "tree").where("tag = 'define-functional-event'").select("file", "line", F.col("of_tree").alias("tree"), attr("name").alias("name"), "ordinal")
    named = of.tagged("define-branch").join(in_tree, ["file", "definition"]).select("file", "line", "node", "tree", attr("name").alias("name"), F.concat(F.lit("b:"), "tree", F.lit("."), attr("name")).alias("block"))
    own = lambda tag, kind: of.tagged(tag).select("file", "line", "node", attr("name").alias("name"), F.concat(F.lit(kind), attr("name")).alias("block"))
    sequences, rules = own("define-sequence", "s:"), own("define-rule", "r:")
    blocks = elements.union([t.select("file", F.col("node").alias("definition"), "block") for t in (trees, named, sequences, rules)])
    # of which tree a block is: of sequences and rules, none
    home = trees.select("block", "tree").unionByName(named.select("block", "tree"))

    # a named branch is its own definition, an initial state and a path have the one around them
    units = of.tagged("initial-state", "define-branch", "path").withColumn("definition", F.when(F.col("tag") == "define-branch", F.col("node")).otherwise(F.col("definition")))
    units = units.join(blocks, ["file", "definition"]).join(home, "block")
    last = of.kids(units.select("file", "node")).groupBy("file", "of").agg(F.max_by(F.struct("tag", attr("name").alias("ref"), F.col("node").alias("at")), "ordinal").alias("last"))
    units = units.join(last.withColumnRenamed("of", "node"), ["file", "node"], "left")
    target = F.when(F.col("last.tag").isin(*TARGETS), F.col("last.tag"))
    forks = of.tagged("fork").select(_unit().alias("fork"), attr("functional-event").alias("event"))
    branches = units.select(
        "file", "line", "block", "tree", F.col("tag").alias("kind"), _unit().alias("unit"), attr("name").alias("name"), F.when(F.col("tag") == "path", attr("state")).alias("state"),
        F.when(F.col("tag") == "path", _unit("parent")).alias("fork"), target.alias("target"), F.when(target == "fork", _unit("last.at")).otherwise(F.col("last.ref")).alias("next"),
    ).join(forks, "fork", "left")

    instructions = of.tagged(*INSTRUCTIONS).where("owner IS NOT NULL").join(blocks, ["file", "definition"])
    states = of.kids(of.tagged("set-house-event").select("file", "node")).where("tag = 'constant'").select("file", F.col("of").alias("node"), casts.to_bool(attr("value")).alias("state"))
    instructions = instructions.join(states, ["file", "node"], "left").select("file", "line", "node", "parent", "owner", "block", F.col("tag").alias("kind"), attr("name").alias("ref"), "state")
    by_target = branches.where("target IN ('branch', 'sequence')").select(F.col("block").alias("a"), F.when(F.col("target") == "branch", F.concat(F.lit("b:"), "tree", F.lit("."), "next")).otherwise(F.concat(F.lit("s:"), "next")).alias("b"), "target")
    by_call = instructions.where("kind IN ('rule', 'event-tree')").select(F.col("block").alias("a"), F.concat(F.when(F.col("kind") == "rule", "r:").otherwise("t:"), F.col("ref")).alias("b"), F.col("kind").alias("target"))
    references = by_target.unionByName(by_call)

    # children that are neither instructions nor the target
    holders = units.select("file", "node", F.lit(True).alias("aims")).unionByName(sequences.unionByName(rules).select("file", "node", F.lit(False).alias("aims")))
    most = of.kids(holders.select("file", "node")).groupBy("file", "of").agg(F.max("ordinal").alias("most"))
    strange = of.kids(holders, "aims").join(most, ["file", "of"]).where(~F.col("tag").isin(*INSTRUCTIONS) & ~(F.col("of_aims") & (F.col("ordinal") == F.col("most")) & F.col("tag").isin(*TARGETS)))
    return {
        "event_trees": trees, "functional_events": eventtrees.functional_order(functional), "named_branches": named, "sequences": sequences, "rules": rules, "branches": branches,
        "instructions": instructions, "tree_references": references, "strange_instructions": strange.select("file", "line", "tag"),
    }


def _reached_fork(branches: DataFrame) -> DataFrame:
    """(unit, fork): the fork that each unit comes to, through named branches, which must not go in circles."""
    rounds = graphs.Rounds(branches.sparkSession)
    named = branches.where("kind = 'define-branch'").select("tree", F.col("name").alias("next"), F.col("target").alias("to"), F.col("next").alias("further"))
    found = branches.where("target = 'fork'").select("unit", F.col("next").alias("fork"))
    open_ = branches.where("target = 'branch'").select("unit", "tree", "next")
    while not open_.isEmpty():
        stepped = rounds.save(open_.join(named, ["tree", "next"]).select("unit", "tree", "to", "further"))
        found = found.unionByName(stepped.where("to = 'fork'").select("unit", F.col("further").alias("fork")))
        open_ = stepped.where("to = 'branch'").select("unit", "tree", F.col("further").alias("next"))
    return found


def order_problems(branches: DataFrame, functional: DataFrame) -> DataFrame:
    """(tree, event, parent, problem, file, line): forks on a path of a fork whose functional event does not come before theirs."""
    order = functional.select("tree", F.col("name").alias("event"), "ord")
    fork_event = branches.where("fork IS NOT NULL").select("fork", "tree", "event").distinct()
    ordered = fork_event.join(order, ["tree", "event"])
    inner = ordered.select(F.col("fork").alias("inner"), F.col("event").alias("inner_event"), F.col("ord").alias("inner_ord"))
    paths = branches.where("kind = 'path'").select("file", "line", "unit", "fork").join(ordered, "fork")
    found = paths.join(_reached_fork(branches).select("unit", F.col("fork").alias("inner")), "unit").join(inner, "inner").where("inner_ord <= ord")
    problem = F.when(F.col("inner_ord") == F.col("ord"), "functional event twice on a path").otherwise("functional event out of order")
    return found.select("tree", F.col("inner_event").alias("event"), F.col("event").alias("parent"), problem.alias("problem"), "file", "line")


def _without_kind(path: Column) -> Column:
    return F.regexp_replace(path, "(^|->)[tbrs]:", "$1")


def cycles(references: DataFrame) -> list[tuple[str, DataFrame]]:
    """(what, paths) of cycles among rules, named branches and, by the trees they begin at, links."""
    among = lambda kind: references.where(F.col("a").startswith(kind) & F.col("b").startswith(kind)).select("a", "b")
    found = [(what, graphs.some_cycles(among(kind)).select(_without_kind(F.col("path")).alias("path"))) for what, kind in (("rule", "r:"), ("branch", "b:"))]
    links = references.where("target = 'event-tree'").select(F.col("a").alias("node"), "b")
    if links.isEmpty():
        return found
    # a tree's sequences, what they and their rules link to; links elsewhere are another violation
    to_sequences = graphs.reach(references.where(F.col("a").startswith("t:")).select(F.col("a").alias("start")), references.where("target IN ('branch', 'sequence')").select("a", "b"))
    to_sequences = to_sequences.where(F.col("node").startswith("s:")).select(F.col("start").alias("a"), F.col("node").alias("start"))
    in_sequences = graphs.reach(to_sequences.select("start"), references.where("target = 'rule'").select("a", "b")).join(links, "node")
    jumps = to_sequences.join(in_sequences, "start").select("a", "b").distinct()
    return [*found, ("event-tree link", graphs.some_cycles(jumps).select(_without_kind(F.col("path")).alias("path")))]


def misplaced_links(t: dict[str, DataFrame]) -> DataFrame:
    """(block): trees and named branches with a link among their own instructions or those of rules that they use."""
    linked = t["tree_references"].where("target = 'event-tree'").select(F.col("a").alias("node"))
    by_rules = t["tree_references"].where("target = 'rule'").select("a", "b")
    return graphs.reaching(linked, by_rules).where(F.col("node").startswith("t:") | F.col("node").startswith("b:")).select(F.col("node").alias("block"))


def mixed(t: dict[str, DataFrame]) -> DataFrame:
    """(block): trees and named branches that come to both collected expressions and formulas, links followed."""
    edges = t["tree_references"].select("a", "b").distinct()
    comes = [graphs.reaching(t["instructions"].where(F.col("kind") == kind).select(F.col("block").alias("node")), edges) for kind in ("collect-expression", "collect-formula")]
    both = comes[0].join(comes[1], "node", "left_semi")
    return both.where(F.col("node").startswith("t:") | F.col("node").startswith("b:")).select(F.col("node").alias("block"))


def problems(t: dict[str, DataFrame], initiating: DataFrame, houses: DataFrame) -> list[DataFrame]:
    """Violations of the tables; ``initiating``: file, line, name, tree; ``houses``: id."""
    v, at = elements.violation, (F.col("file"), F.col("line"))
    branches, references = t["branches"], t["tree_references"]
    forks = branches.where("fork IS NOT NULL").select("fork", "tree", "event", "state", "file", "line")
    calls = t["instructions"]
    out = [
        v(elements.duplicates(t["event_trees"], "tree"), "2 define", "DuplicateElementError", F.col("tree"), "event tree defined more than once"),
        v(elements.duplicates(t["sequences"], "name"), "2 define", "DuplicateElementError", F.col("name"), "sequence defined more than once"),
        v(elements.duplicates(t["rules"], "name"), "2 define", "DuplicateElementError", F.col("name"), "rule defined more than once"),
        v(elements.duplicates(t["named_branches"], "tree", "name"), "2 define", "DuplicateElementError", F.concat_ws(".", "tree", "name"), "branch defined more than once"),
        v(elements.duplicates(t["functional_events"], "tree", "name"), "2 define", "DuplicateElementError", F.concat_ws(".", "tree", "name"), "functional event defined more than once"),
        v(elements.duplicates(initiating, "name"), "2 define", "DuplicateElementError", F.col("name"), "initiating event defined more than once"),
        v(elements.undefined(initiating.where("tree IS NOT NULL"), t["event_trees"], "tree", "tree"), "2 define", "UndefinedElement", F.col("tree"), F.concat(F.lit("event tree of "), F.col("name")), *at),
        v(forks.join(t["functional_events"].select("tree", F.col("name").alias("event")), ["tree", "event"], "left_anti").select("fork", "event", "file").distinct().withColumn("line", F.lit(None).cast("int")), "2 define", "UndefinedElement", F.col("event"), "functional event of a fork", *at),
        v(eventtrees.duplicate_states(forks.select(F.col("fork").alias("fork_id"), "state")), "2 define", "ValidityError", F.col("state"), "state twice in a fork"),
        v(forks.where("state = ''"), "2 define", "LogicError", F.col("fork"), "path without a state", *at),
        v(branches.where("target IS NULL"), "2 define", "ValidityError", F.col("block"), "branch without a target", *at),
        v(elements.undefined(branches.where("target = 'sequence'"), t["sequences"], "next", "name"), "2 define", "UndefinedElement", F.col("next"), "sequence of a branch", *at),
        v(branches.where("target = 'branch'").join(t["named_branches"].select("tree", F.col("name").alias("next")), ["tree", "next"], "left_anti"), "2 define", "UndefinedElement", F.col("next"), "branch of a branch", *at),
        v(elements.undefined(calls.where("kind = 'rule'"), t["rules"], "ref", "name"), "2 define", "UndefinedElement", F.col("ref"), "rule of an instruction", *at),
        v(elements.undefined(calls.where("kind = 'event-tree'"), t["event_trees"], "ref", "tree"), "2 define", "UndefinedElement", F.col("ref"), "event tree of a link", *at),
        v(elements.undefined(calls.where("kind = 'set-house-event'"), houses, "ref", "id"), "2 define", "UndefinedElement", F.col("ref"), "house event of an instruction", *at),
        v(t["strange_instructions"], "2 define", "ValidityError", F.col("tag"), "unknown instruction", *at),
    ]
    if references.isEmpty() and forks.isEmpty():
        return out
    circles = cycles(references)
    out += [v(paths, "3 validate", "CycleError", F.col("path"), f"cycle among {what}es" if what == "branch" else f"cycle among {what}s") for what, paths in circles]
    if all(paths.isEmpty() for what, paths in circles if what == "branch"):  # else no way through branches has an end
        found = order_problems(branches, t["functional_events"])
        out.append(v(found, "3 validate", "ValidityError", F.concat_ws(".", "tree", "event"), F.concat("problem", F.lit(" after "), "parent"), *at))
    out.append(v(misplaced_links(t), "3 validate", "ValidityError", _without_kind(F.col("block")), "links belong into sequences"))
    out.append(v(mixed(t), "3 validate", "ValidityError", _without_kind(F.col("block")), "collects both expressions and formulas"))
    return out


def walk(model) -> DataFrame:
    """All ways from initiating events to sequences; see ``sequences.walk``."""
    from . import sequences

    return sequences.walk(model)
