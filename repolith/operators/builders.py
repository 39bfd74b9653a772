"""Graph builders: module, symbol, call and taint graphs as joins over the entity tables.

Entity tables: modules (id, seq), imports (module_id, pos, specifier, kind, imported_name, local_name), symbols,
functions (id, module_id, owner_class_id, name, start, end, seq), classes (id, module_id, name, extends_symbol_id,
methods, seq), call_sites (function_id, site_pos, callee_kind, callee_name, receiver_text, call_apply_bind_kind,
is_new, has_function_argument, start, end, path, line, col). start and end are offsets. Edges carry id, type, src,
dst, certainty and seq, the order of insertion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions import dims
from repolith.functions.columns import certainty_name, dirname, is_relative, matches_signature, normalise_path
from repolith.operators.graph import first_paths, unique_edges
from repolith.operators.lineage import cut, numbered, settled, small


def candidates(folder: Column, specifier: Column) -> Column:
    """Module paths that a relative specifier in a folder may mean, best first."""
    joined = normalise_path(F.concat_ws("/", folder, specifier))
    known = F.regexp_extract(joined, r"(\.tsx|\.mts|\.cts|\.ts|\.jsx|\.mjs|\.cjs|\.js)$", 1)
    bare = F.substring(joined, F.lit(1), F.length(joined) - F.length(known))
    ends = lambda base, tail: [F.concat(base, F.lit(tail.format(e))) for e in dims.MODULE_EXTENSIONS]
    swapped = [F.when(known != "", c) for c in ends(bare, "{}")]
    index = [F.when(joined == "", F.lit(f"index{e}")).otherwise(F.concat(joined, F.lit(f"/index{e}"))) for e in dims.MODULE_EXTENSIONS]
    return F.array(joined, *ends(joined, "{}"), *swapped, *index)


def resolve_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """imports with target: the first candidate that is a module, null for bare and unresolved specifiers.

    Folders and specifiers repeat, so each distinct pair is resolved once and joined back.
    """
    placed = imports.withColumn("_folder", dirname(F.col("module_id")))
    asked = placed.where(is_relative(F.col("specifier"))).select("_folder", "specifier").distinct()
    asked = asked.select("_folder", "specifier", F.posexplode(candidates(F.col("_folder"), F.col("specifier"))).alias("ord", "path"))
    found = asked.join(modules.select(F.col("id").alias("path")).distinct(), "path").groupBy("_folder", "specifier").agg(F.min_by("path", "ord").alias("target"))
    return placed.join(found, ["_folder", "specifier"], "left").select(*imports.columns, "target")


def import_bindings(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(src, dst, line, col): where the first import, by pos, that binds one module to another is."""
    at = [F.col(c) if c in imports.columns else F.lit(None).cast("int").alias(c) for c in ("line", "col")]
    found = resolve_imports(imports, modules).where("target is not null").withColumn("_first", F.struct("pos", "specifier", *at))
    found = found.groupBy(F.col("module_id").alias("src"), F.col("target").alias("dst")).agg(F.min("_first").alias("_first"))
    return found.select("src", "dst", "_first.line", "_first.col")


def callbacks(sites: DataFrame, functions: DataFrame, group: str = "module_id") -> DataFrame:
    """(``site`` columns, callback, inner): functions (id, group, start, end, seq) strictly inside a call site's span (start,
    end) of the same group, by interval bins.

    A span of up to 2**k places touches at most two bins of that width, and what lies inside begins in one of them, so
    both sides meet by equality of (group, width, bin), and a group of any size is spread. Places are whole numbers.
    """
    width = lambda: F.length(F.bin(F.greatest(F.col("end") - F.col("start"), F.lit(0))))
    bin_ = lambda c: F.expr(f"shiftright({c}, cast(_width as int))")
    outer = sites.where("start is not null and end is not null").withColumn("_width", width().cast("int"))
    outer = outer.withColumn("_bin", F.explode(F.sequence(bin_("start"), bin_("end"))))
    widths = outer.select("_width").distinct()  # 64 at most
    inner = functions.where("start is not null and end is not null").select(F.col(group), F.col("id").alias("callback"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("seq").alias("inner"))
    inner = inner.join(F.broadcast(widths), F.length(F.bin(F.greatest(F.col("_e") - F.col("_s"), F.lit(0)))) <= F.col("_width")).withColumn("_bin", bin_("_s"))
    within = F.expr("_s >= start and _e <= end and (_s > start or _e < end)")
    return outer.join(inner, [group, "_width", "_bin"]).where(within).select(*sites.columns, "callback", "inner")


def edge(kind: str, src: Column, dst: Column, certainty, seq: Column) -> list[Column]:
    certainty = F.lit(certainty) if isinstance(certainty, str) else certainty
    ident = F.concat(F.lit(f"{kind}:"), src, F.lit("->"), dst)
    return [ident.alias("id"), F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"), certainty.alias("certainty"), seq.cast("long").alias("seq")]


def node(prefix: str, ident: Column | str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(ident) if isinstance(ident, str) else ident)


def ordered(edges: DataFrame, *order) -> DataFrame:
    """Edges with seq by the given order, the first of each id kept."""
    place = Window.partitionBy("id").orderBy(*order)
    kept = edges.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")
    return numbered(kept, *order)


def module_graph(modules: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = modules.select(node("module", "id").alias("id"), F.lit("module").alias("type"), F.col("id").alias("entity_id"))
    found = resolve_imports(imports.where("kind <> 're-export'"), modules).where("target is not null")
    found = found.join(modules.select(F.col("id").alias("module_id"), F.col("seq").alias("module_seq")), "module_id")
    rows = found.select(*edge("IMPORTS", node("module", "module_id"), node("module", "target"), "resolved", F.lit(0)), "module_seq", "pos")
    return nodes, ordered(rows, "module_seq", "pos").drop("module_seq", "pos")


def symbol_graph(modules: DataFrame, symbols: DataFrame, functions: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DECLARES from modules to symbols, free functions and classes; EXTENDS and IMPLEMENTS from classes to symbols."""
    parts = (("module", modules), ("symbol", symbols), ("function", functions), ("class", classes))
    nodes = None
    for kind, rows in parts:
        part = rows.select(node(kind, "id").alias("id"), F.lit(kind).alias("type"), F.col("id").alias("entity_id"))
        nodes = part if nodes is None else nodes.union(part)
    known = modules.select(F.col("id").alias("module_id"))
    rows = []
    for n, (kind, frame) in enumerate((("symbol", symbols), ("function", functions.where("owner_class_id is null")), ("class", classes))):
        declared = frame.join(known, "module_id", "left_semi")
        rows.append(declared.select(*edge("DECLARES", node("module", "module_id"), node(kind, "id"), "direct", F.lit(0)), F.lit(n).alias("part"), F.col("seq").alias("at")))
    base = classes.select("id", "seq", F.col("extends_symbol_id").alias("target"), F.lit("EXTENDS").alias("kind"), F.lit(3).alias("part"))
    base = base.union(classes.select("id", "seq", F.explode("implements_symbol_ids"), F.lit("IMPLEMENTS"), F.lit(4)))
    base = base.join(symbols.select(F.col("id").alias("target")), "target", "left_semi")
    for kind in ("EXTENDS", "IMPLEMENTS"):
        rows.append(base.where(F.col("kind") == kind).select(*edge(kind, node("class", "id"), node("symbol", "target"), "resolved", F.lit(0)), "part", F.col("seq").alias("at")))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return nodes, ordered(out, "part", "at", "id").drop("part", "at")


#: What a call leads to, by ``kind`` of ``call_targets``.
GOALS = ["function", "class", "module", "symbol", "call-site"]

#: Narrow rows of classes that a broadcast may hold.
MOST_CLASSES = 1_000_000


def placed_sites(functions: DataFrame, call_sites: DataFrame) -> DataFrame:
    """call_sites with module_id, owner_class_id and fn_seq of their functions; where they have these already, as they are."""
    if {"module_id", "owner_class_id", "fn_seq"} <= set(call_sites.columns):
        return call_sites
    return call_sites.join(functions.select(F.col("id").alias("function_id"), "module_id", "owner_class_id", F.col("seq").alias("fn_seq")), "function_id")


def call_targets(modules, imports, functions, classes, sites) -> DataFrame:
    """What the calls of ``sites`` (as of ``placed_sites``) lead to: their columns, kind (a place in GOALS), to (the id of a function,
    class or symbol), to_module and rank (of certainty).

    Names are resolved where they are declared and imported, and each site is shuffled at most twice: only sites that ask for
    a name meet names, once, and computed ones meet nothing. Ids may be of any one type; short ones make small shuffles.
    """
    first = lambda rows, key, out: rows.groupBy(*key).agg(F.min_by("id", "seq").alias(out))
    fn, cl = first(functions.where("owner_class_id is null"), ["module_id", "name"], "fn"), first(classes, ["module_id", "name"], "cl")
    called = F.col("callee_kind") == "call-apply-bind"
    tail = F.substring_index("receiver_text", ".", -1)
    dotted = F.instr("receiver_text", ".") > 0
    columns = sites.columns
    sites = sites.withColumns({
        "name": F.when(called, F.when(dotted, tail).otherwise(F.col("receiver_text"))).otherwise(F.col("callee_name")),
        "recv": F.when(called, F.when(dotted, F.expr("substring(receiver_text, 1, length(receiver_text) - length(substring_index(receiver_text, '.', -1)) - 1)"))).otherwise(F.col("receiver_text")),
        "shape": F.when(called, F.when(dotted, "member").otherwise("identifier")).otherwise(F.when(F.col("callee_kind") == "computed-member", F.when(F.col("callee_name").isNotNull(), "member").otherwise("computed")).otherwise(F.col("callee_kind"))),
        "called": F.coalesce(called, F.lit(False)),
    })
    identifier, member = F.col("shape") == "identifier", F.col("shape") == "member"
    this = F.coalesce(F.col("recv") == "this", F.lit(False))
    sites = sites.withColumns({"look": F.when(identifier, F.col("name")).when(member & ~this, F.col("recv")), "this": this})
    # Of imports that bind one name the first counts; specifiers repeat and are resolved apart.
    imports = imports.where("local_name is not null and kind not in ('dynamic', 're-export')")
    meant = resolve_imports(imports.select("module_id", "specifier").distinct(), modules)
    bound = imports.groupBy("module_id", F.col("local_name").alias("look"))
    bound = bound.agg(F.min_by(F.struct("specifier", F.coalesce("imported_name", "local_name").alias("remote")), "pos").alias("b"))
    bound = bound.select("module_id", "look", "b.specifier", "b.remote").join(meant, ["module_id", "specifier"], "left").drop("specifier")
    far = lambda rows, out, col: rows.select(F.col("module_id").alias("target"), F.col("name").alias("remote"), F.col(col).alias(out))
    bound = bound.join(far(fn, "far_fn", "fn"), ["target", "remote"], "left").join(far(cl, "far_cl", "cl"), ["target", "remote"], "left").drop("remote")
    names = fn.withColumnRenamed("name", "look").unionByName(cl.withColumnRenamed("name", "look"), allowMissingColumns=True).unionByName(bound, allowMissingColumns=True)
    names = names.groupBy("module_id", "look").agg(*[F.max(c).alias(c) for c in ("fn", "cl", "target", "far_fn", "far_cl")])
    base = classes.alias("c").join(classes.alias("s"), F.col("c.extends_symbol_id") == F.col("s.symbol_id"), "left").where("c.extends_symbol_id is not null")
    base, n = settled(base.select(F.col("c.id").alias("owner"), F.col("c.extends_symbol_id").alias("base_symbol"), F.col("s.id").alias("base")))
    base = small(base, n, MOST_CLASSES)
    methods = functions.where("owner_class_id is not null").groupBy("owner_class_id", "name").agg(F.min_by("id", "seq").alias("m"))
    above = methods.select(F.col("owner_class_id").alias("base"), "name", F.col("m").alias("base_m")).join(base.where("base is not null"), "base").select("owner", "name", "base_m")
    found = sites.where("look is not null").join(names, ["module_id", "look"], "left")
    found = found.unionByName(sites.where("look is null and (shape in ('identifier', 'member'))"), allowMissingColumns=True)
    found = found.withColumn("owner", F.when(member, F.when(F.col("this"), F.col("owner_class_id")).otherwise(F.coalesce("cl", "far_cl"))))
    found = found.join(methods.select(F.col("owner_class_id").alias("owner"), "name", F.col("m").alias("own_m")), ["owner", "name"], "left").join(above, ["owner", "name"], "left")
    found = found.join(base.select("owner", "base_symbol"), "owner", "left")
    function, class_, module, symbol, site = (F.lit(k) for k in range(len(GOALS)))
    unknown, dynamic, inferred, there, here = (F.lit(k) for k in range(len(dims.CERTAINTIES)))
    of = F.struct(unknown.alias("kind"), F.coalesce("fn", "cl", "base_symbol").alias("to"), F.col("target").alias("to_module"), unknown.alias("rank"))
    kind_of = found.select(of.alias("g")).schema["g"].dataType
    goal = lambda kind, rank, to=F.lit(None), at=F.lit(None): F.struct(kind.alias("kind"), to.alias("to"), at.alias("to_module"), rank.alias("rank")).cast(kind_of)
    has = lambda c: F.col(c).isNotNull()
    class_first = F.coalesce(F.col("is_new"), F.lit(False))
    pick = lambda f, c, rank: F.when(has(c) & (class_first | ~has(f)), goal(class_, rank, F.col(c))).when(has(f), goal(function, rank, F.col(f)))
    by_name = F.coalesce(pick("fn", "cl", here), pick("far_fn", "far_cl", there), F.when(has("target"), goal(module, unknown, at=F.col("target"))).when(F.col("called"), goal(site, dynamic)))
    by_class = (
        F.when(has("own_m"), goal(function, F.when(F.col("this") | has("cl"), here).otherwise(there), F.col("own_m")))
        .when(has("base_m"), goal(function, inferred, F.col("base_m")))
        .when(has("base_symbol"), goal(symbol, unknown, F.col("base_symbol")))
        .otherwise(goal(site, F.when(F.col("called"), dynamic).otherwise(unknown)))
    )
    found = found.withColumn("goal", F.when(identifier, by_name).when(member, by_class)).where("goal is not null").select(*columns, "goal.*")
    return found.unionByName(sites.where("shape = 'computed'").withColumn("goal", goal(site, dynamic)).select(*columns, "goal.*"))


def call_graph(modules, imports, functions, classes, call_sites) -> tuple[DataFrame, DataFrame]:
    """CALLS edges. Names resolve in the module (direct), through imports (resolved), through a class's methods or
    its base (direct, inferred, unknown); computed members are dynamic; what no rule resolves goes to a node of
    the call site (unknown). External names give no edge."""
    sites = placed_sites(functions, call_sites)
    calls = call_targets(modules, imports, functions, classes, sites)
    kind = F.element_at(F.array(*map(F.lit, GOALS)), F.col("kind") + 1)
    site = F.concat_ws(":", kind, "function_id", "path", "line", "col")
    dst = F.when(kind == "call-site", site).otherwise(F.concat_ws(":", kind, F.when(kind == "module", F.col("to_module")).otherwise(F.col("to"))))
    rows = calls.select(*edge("CALLS", node("function", "function_id"), dst, certainty_name(F.col("rank")), F.lit(0)), "fn_seq", "site_pos", F.lit(1).alias("part"), F.lit(0).alias("inner"))
    backs = callbacks(sites.where("has_function_argument").select("function_id", "fn_seq", "site_pos", "module_id", "start", "end"), functions).where("callback <> function_id")
    rows = rows.union(backs.select(*edge("CALLS", node("function", "function_id"), node("function", "callback"), "unknown", F.lit(0)), "fn_seq", "site_pos", F.lit(0), "inner"))
    edges = cut(ordered(rows, "fn_seq", "site_pos", "part", "inner").drop("fn_seq", "site_pos", "part", "inner"))
    parts = (("module", modules), ("function", functions), ("class", classes))
    nodes = None
    for kind, frame in parts:
        part = frame.select(node(kind, "id").alias("id"), F.lit(kind).alias("type"), F.col("id").alias("entity_id"))
        nodes = part if nodes is None else nodes.union(part)
    extra = edges.where("dst like 'call-site:%' or dst like 'symbol:%'").select(F.col("dst").alias("id"), F.substring_index("dst", ":", 1).alias("type"), F.expr("substring(dst, instr(dst, ':') + 1)").alias("entity_id"))
    return nodes.union(extra.distinct()), edges


def signatures(spark) -> DataFrame:
    schema = "ord int, signature string, role string, kind string, callee_kind string, callee_names array<string>, receiver string, receiver_starts string, receiver_ends array<string>"
    return spark.createDataFrame([(i, *row) for i, row in enumerate(dims.TAINT_SIGNATURES)], schema)


def classified(call_sites: DataFrame) -> DataFrame:
    """(function_id, site_pos, ord, end, signature, role, kind) of every call site and signature that match."""
    rules = F.broadcast(signatures(call_sites.sparkSession))
    pairs = call_sites.withColumn("s", F.struct(*call_sites.columns)).join(rules.select(F.struct(*rules.columns).alias("m")), matches_signature("s", "m"))
    return pairs.select("function_id", "site_pos", "m.ord", "end", "m.signature", "m.role", "m.kind")


def ordered_sanitizers(points: DataFrame, key: str) -> DataFrame:
    """Keys with a sanitizer strictly between the ends of some source and of some sink: the window runs from the
    least to the greatest of a pair. points: (key, role, at)."""
    of = lambda role: points.where(F.col("role") == role)
    low = of("source").groupBy(key).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    sink = of("sink").groupBy(key).agg(F.min("at").alias("sink_lo"), F.max("at").alias("sink_hi"))
    both = low.join(sink, key)
    window = both.select(key, F.least("lo", "sink_lo").alias("from"), F.greatest("hi", "sink_hi").alias("to"))
    span = window.join(both, key)
    forward, backward = F.struct(F.col("lo").alias("a"), F.col("sink_hi").alias("b")), F.struct(F.col("sink_lo").alias("a"), F.col("hi").alias("b"))
    span = span.select(key, F.explode(F.array(forward, backward)).alias("w")).where("w.a < w.b")
    return of("sanitizer").join(span, key).where("at > w.a and at < w.b").select(key).distinct()


def taint_graph(functions: DataFrame, call_sites: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FLOWS_TO edges from functions with a source to functions with a sink that they reach through CALLS."""
    found = cut(classified(call_sites))
    first = lambda role, p: found.where(F.col("role") == role).groupBy("function_id").agg(F.min_by("kind", F.struct("site_pos", "ord")).alias(f"{p}_kind"), F.transform(F.array_sort(F.collect_list(F.struct("site_pos", "ord", "signature"))), lambda x: x["signature"]).alias(f"{p}_signatures"))
    sources, sinks = cut(first("source", "source")), cut(first("sink", "sink"))
    clean = found.where("role = 'sanitizer'").select(node("function", "function_id").alias("n")).distinct()
    local = ordered_sanitizers(found.where("end is not null").select("function_id", "role", F.col("end").alias("at")), "function_id").withColumn("local", F.lit(True))
    ends = lambda rows: rows.select(node("function", "function_id").alias("id"))
    paths = cut(first_paths(calls, ends(sources), ends(sinks)))
    dirty = paths.select("source", "target", F.explode("nodes").alias("n")).join(clean, "n").select("source", "target").distinct().withColumn("crossed", F.lit(True))
    out = paths.join(dirty, ["source", "target"], "left")
    cutoff = lambda c: F.expr(f"substring({c}, length('function:') + 1)")
    out = out.withColumns({"source_fn": cutoff("source"), "sink_fn": cutoff("target")})
    out = out.join(sources.withColumnRenamed("function_id", "source_fn"), "source_fn").join(sinks.withColumnRenamed("function_id", "sink_fn"), "sink_fn")
    out = out.join(local.withColumnRenamed("function_id", "source_fn"), "source_fn", "left")
    sanitized = F.when(F.col("source") == F.col("target"), F.coalesce("local", F.lit(False))).otherwise(F.coalesce("crossed", F.lit(False)))
    seqs = functions.select(F.col("id").alias("fid"), F.col("seq").alias("fseq"))
    out = out.join(seqs.withColumnsRenamed({"fid": "source_fn", "fseq": "s1"}), "source_fn").join(seqs.withColumnsRenamed({"fid": "sink_fn", "fseq": "s2"}), "sink_fn")
    data = F.struct("source_kind", "sink_kind", "source_signatures", "sink_signatures", sanitized.alias("sanitized"))
    rows = out.select(*edge("FLOWS_TO", F.col("source"), F.col("target"), F.col("weakest"), F.lit(0)), data.alias("data"), "s1", "s2")
    nodes = functions.select(node("function", "id").alias("id"), F.lit("function").alias("type"), F.col("id").alias("entity_id"))
    return nodes, unique_edges(ordered(rows, "s1", "s2").drop("s1", "s2"))
