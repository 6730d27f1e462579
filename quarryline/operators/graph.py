"""A typed symbol graph: nodes, edges in long form, and expansion over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Edge types and their inverses. 'imports' names modules, not nodes, and is never followed.
INVERSE = {"calls": "called_by", "inherits": "inherited_by", "references": "referenced_by", "defines": "defined_in"}
FOLLOWED = (*INVERSE, *INVERSE.values())
#: Relations that a context shows.
SHOWN = ("calls", "called_by", "inherits", "references", "referenced_by")
#: About how many names a part of a hub's context holds.
NAMES = 1000
#: Chunk types whose imports are the objects they refer to.
REFERRING = ("view", "procedure", "function", "trigger", "index")


def with_inverse(edges: DataFrame, inverse: dict[str, str]) -> DataFrame:
    """edges (src, dst, edge_type) and their inverses under the inverse names."""
    name = F.create_map(*[F.lit(x) for kv in inverse.items() for x in kv])
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), name[F.col("edge_type")].alias("edge_type"))).distinct()


def resolve(calls: DataFrame, symbols: DataFrame, ordered: bool = True) -> DataFrame:
    """calls (src, file, seq, name) to symbols (id, file, seq, name): candidates of the same file if any, else all.

    ordered: only symbols inserted by then count, as an incremental build would see them; seq may be any type that has an
    order. A call meets its own file's symbols first, under file and name; only what is left meets the other files'.
    """
    s = symbols.select(F.col("id").alias("dst"), F.col("file").alias("dst_file"), F.col("seq").alias("dst_seq"), "name")
    by_then = F.col("dst_seq") <= F.col("seq") if ordered else F.lit(True)
    near = calls.join(s, (calls["file"] == s["dst_file"]) & (calls["name"] == s["name"]) & by_then).select("src", calls["name"], "dst")
    left = calls.join(near.select("src", "name").distinct(), ["src", "name"], "left_anti")
    far = left.join(s, "name").where(by_then).select("src", "name", "dst")
    return near.unionByName(far).select("src", "dst", F.lit("calls").alias("edge_type")).distinct()


def nodes(chunks: DataFrame) -> DataFrame:
    """(id, type, file, name, signature, line) of chunks, one for each id: of equal ids the one that begins last."""
    last = F.max_by(F.struct("type", "file", "name", "signature", F.col("line_start").alias("line")), F.struct("line_start", "content"))
    return chunks.groupBy("id").agg(last.alias("n")).select("id", "n.*")


def edges(chunks: DataFrame, ordered: bool = False) -> DataFrame:
    """(src, dst, edge_type) of chunks (id, file, type, name, parent, calls, imports, line_start), both ways.

    A call goes to the symbols that have its name, those of its own file if there are any; so do a class's bases
    (inherits) and the objects that SQL statements refer to (references). A member is defined by its parent. A module's
    imports are kept under the names that they import.

    ordered: as if the chunks were inserted one by one, file by file and by line: a name means only symbols inserted by
    then, the chunk itself included, and a parent has a member only if it came before it. Otherwise all chunks count.

    The three relations by name are resolved in one pass: what is wanted differs in a label only.
    """
    own = chunks.select("id", "file", "type", "name", "parent", "calls", "imports", F.struct("file", "line_start", "id").alias("seq"))
    symbols = own.groupBy("id", "file", "name").agg(F.min("seq").alias("seq"))
    none = F.array().cast("array<string>")
    wanted = lambda kind, names: F.transform(F.coalesce(names, none), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    of_type = lambda types: F.when(F.col("type").isin(*types), F.col("imports"))
    asked = F.concat(wanted("calls", F.col("calls")), wanted("inherits", of_type(("class",))), wanted("references", of_type(REFERRING)))
    each = own.select(F.col("id").alias("src"), "file", "seq", F.explode(asked).alias("w")).select("src", "file", "seq", "w.name", "w.kind")
    once = each.groupBy("src", "file", "name").agg(F.max("seq").alias("seq"), F.collect_set("kind").alias("kinds"))
    found = resolve(once.drop("kinds"), symbols, ordered)
    names = symbols.select(F.col("id").alias("dst"), "name")
    out = found.select("src", "dst").join(names, "dst").join(once.select("src", "name", "kinds"), ["src", "name"]).select("src", "dst", F.explode("kinds").alias("edge_type"))
    member = own.where("parent is not null").select(F.concat("file", F.lit(":"), "parent").alias("src"), F.col("id").alias("dst"), "seq")
    parents = symbols.select(F.col("id").alias("src"), F.col("seq").alias("own_seq"))
    defines = member.join(parents, "src").where(F.col("own_seq") <= F.col("seq") if ordered else F.lit(True)).select("src", "dst", F.lit("defines").alias("edge_type"))
    modules = own.where("type = 'module'").select(F.col("id").alias("src"), F.explode("imports").alias("dst"), F.lit("imports").alias("edge_type"))
    return with_inverse(out.unionByName(defines).distinct(), INVERSE).unionByName(modules.distinct())


def reachable(edges: DataFrame, starts: DataFrame, hops: int, edge_types: list[str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """(start, id, hop): for each start (column id) the nodes within hops of it, without itself, each at its smallest
    distance. Follows edge_types, by default all but imports; with known (id), only nodes among them."""
    own = edges.where(F.col("edge_type").isin(*(edge_types or FOLLOWED))).select("src", "dst") if "edge_type" in edges.columns else edges.select("src", "dst")
    if known is not None:
        own = own.join(known.select(F.col("id").alias("dst")), "dst", "left_semi")
    seen = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hop")).distinct()
    front = seen.select("start", "id")
    for h in range(1, hops + 1):
        step = front.join(own, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id")).distinct()
        front = step.join(seen.select("start", "id"), ["start", "id"], "left_anti")
        seen = seen.unionByName(front.withColumn("hop", F.lit(h)))
    return seen.where("hop > 0")


def neighbors(edges: DataFrame, starts: DataFrame, hops: int, edge_types: list[str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """(id, hop): nodes within hops of starts (column id), without them; each at its smallest distance."""
    near = reachable(edges, starts, hops, edge_types, known).groupBy("id").agg(F.min("hop").alias("hop"))
    return near.join(starts.select("id").distinct(), "id", "left_anti")


def remove_prefix(edges: DataFrame, prefix: str) -> DataFrame:
    """Without edges that touch a node whose id starts with prefix; imports, which name modules, go by their source only."""
    kept = ~F.col("dst").startswith(prefix)
    return edges.where(~F.col("src").startswith(prefix) & (kept | (F.col("edge_type") == "imports") if "edge_type" in edges.columns else kept))


def related(edges: DataFrame, known: DataFrame, ids: DataFrame, edge_type: str) -> DataFrame:
    """The nodes (id, name and the other columns of known) that ids (id) have edges of a type to, with ``of``: whose they are.
    Callers: called_by; callees: calls."""
    own = edges.where(F.col("edge_type") == edge_type).join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    return own.select(F.col("src").alias("of"), F.col("dst").alias("id")).join(known, "id")


def context(edges: DataFrame, known: DataFrame, ids: DataFrame, shown: tuple[str, ...] = SHOWN) -> DataFrame:
    """(id, edge_type, names): for each of ids and each relation shown, the names of the related nodes, sorted; ids and
    relations without any are left out. known: (id, name)."""
    own = edges.where(F.col("edge_type").isin(*shown)).join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    named = own.join(known.select(F.col("id").alias("dst"), "name"), "dst")
    return named.groupBy(F.col("src").alias("id"), "edge_type").agg(F.sort_array(F.collect_list("name")).alias("names"))


def context_parts(edges: DataFrame, known: DataFrame, ids: DataFrame, names: int = NAMES, shown: tuple[str, ...] = SHOWN) -> DataFrame:
    """(id, context, part): for each of ids its :func:`context` as a map of relation to names, null without any. A node of more
    than ``names`` has them in parts of about as many, a row each, numbered from 0; each related node's name lies in one.

    So a hub's names, which grow with the graph, meet in no one task. They are written before they are counted and dealt."""
    ids = ids.select("id").distinct()
    own = edges.where(F.col("edge_type").isin(*shown)).join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    named = written(own.join(known.select(F.col("id").alias("dst"), "name"), "dst").select(F.col("src").alias("id"), "edge_type", "dst", "name"), "related")
    hubs = named.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / names).alias("parts")).where("parts > 1")
    part = F.coalesce(F.pmod(F.xxhash64("edge_type", "dst"), F.col("parts")), F.lit(0)).cast("int")
    dealt = named.join(F.broadcast(hubs), "id", "left").select("id", part.alias("part"), "edge_type", "name")
    each = dealt.unionByName(ids.select("id", F.lit(0).alias("part")), allowMissingColumns=True).repartition("id", "part")  # every id has a part
    each = each.groupBy("id", "part", "edge_type").agg(F.sort_array(F.collect_list("name")).alias("names"))
    entries = F.array_sort(F.collect_list(F.when(F.col("edge_type").isNotNull(), F.struct("edge_type", "names"))))
    return each.groupBy("id", "part").agg(entries.alias("e")).select("id", F.when(F.size("e") > 0, F.map_from_entries("e")).alias("context"), "part")


def stats(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(kind, item, n): nodes in all and by type (known: id, type), and edges in the forward direction."""
    forward = edges.where(F.col("edge_type").isin(*INVERSE)).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("kind"), F.lit("forward").alias("item"), "n")
    by = known.groupBy(F.col("type").alias("item")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("type").alias("kind"), "item", "n")
    return known.agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("kind"), F.lit("all").alias("item"), "n").unionByName(forward).unionByName(by)
