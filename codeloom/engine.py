"""One object for a repository: builds its relations once and answers the engine's queries from them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import calls, graph, imports, packing, parsing, rank, report, search
from .sources import packages, repository
from .streaming import changes
from .tables import small, written


class Repository:
    """files has path (relative) and content. Relations are made at first use; refresh() forgets them."""

    def __init__(self, files: DataFrame, source_roots: tuple[str, ...] | None = None, embedder=search.hashing_embedder, compat: str | None = None, excluded: tuple[str, ...] = ()) -> None:
        #: Parts of folder names that the property graph and calls leave out.
        self.excluded = excluded
        self.files, self.given_roots, self.embedder, self.compat = files, source_roots, embedder, compat
        #: Paths of files that came in later with a syntax error: their sound parts count.
        self.tolerated: DataFrame | None = None

    @classmethod
    def read(cls, spark: SparkSession, root: str, **settings) -> Repository:
        """The repository in a folder, with the source roots that its configuration file names, if it has one."""
        return cls(repository.read_repository(spark, root), **{"source_roots": repository.configured_roots(root)} | settings)

    def refresh(self, files: DataFrame | None = None) -> None:
        self.files = self.files if files is None else files
        for name in [n for n in self.__dict__ if isinstance(getattr(type(self), n, None), cached_property)]:
            del self.__dict__[name]

    @cached_property
    def source_roots(self) -> tuple[str, ...]:
        return tuple(packages.source_roots(self.files)) if self.given_roots is None else self.given_roots

    @cached_property
    def syntax(self) -> DataFrame:
        return written(parsing.checked(self.files), "syntax")

    @cached_property
    def nodes(self) -> DataFrame:
        """Files of a known language without syntax errors."""
        sound = self.syntax.filter("is_valid").select("path")
        if self.tolerated is not None:
            sound = sound.unionByName(self.tolerated).distinct()
        return written(parsing.with_language(self.files).join(sound, "path", "left_semi").select("path", "language", graph.family_of(F.col("language")).alias("family")), "nodes")

    @cached_property
    def symbols(self) -> DataFrame:
        return written(parsing.symbols(self.files), "symbols")

    @cached_property
    def raw_imports(self) -> DataFrame:
        return written(parsing.imports(self.files), "imports")

    @cached_property
    def module_index(self) -> DataFrame:
        return written(imports.module_index(self.files, self.source_roots), "modules")

    @cached_property
    def resolved_imports(self) -> DataFrame:
        return written(imports.resolved(self.raw_imports, self.files, self.module_index, self.source_roots, packages.third_party(self.files)), "resolved")

    @cached_property
    def import_targets(self) -> DataFrame:
        spark = self.files.sparkSession
        configs = [(r.path, r.content) for r in self.files.filter(F.col("path").isin("tsconfig.json", "jsconfig.json")).collect()]
        base, pairs = packages.path_aliases(configs)
        aliases = spark.createDataFrame(pairs, "pattern string, target string") if pairs else None
        js = imports.js_resolved(self.raw_imports, self.files, aliases, base).select(F.col("path").alias("src"), F.col("resolved_path").alias("dst"))
        return written(imports.import_targets(self.resolved_imports).unionByName(js).distinct(), "targets")

    @cached_property
    def edges(self) -> DataFrame:
        found = imports.import_edges(self.import_targets, self.nodes).join(self.nodes.select(F.col("path").alias("src")), "src", "left_semi")
        named = self.symbols.join(self.nodes.select("path", "family"), "path")
        usage = graph.symbol_usage_edges(named.filter("is_definition"), named.filter("not is_definition"), found, compat=self.compat).withColumn("kind", F.lit("SymbolUsage"))
        return written(graph.upgraded_edges(found.unionByName(usage)), "edges")

    @cached_property
    def ranks(self) -> DataFrame:
        return written(rank.pagerank(self.nodes, self.edges), "ranks")

    @cached_property
    def skeletons(self) -> DataFrame:
        return written(parsing.skeletons(self.files), "skeletons")

    @cached_property
    def chunk_embeddings(self) -> DataFrame:
        texts = self.nodes.select("path").join(self.skeletons, "path").join(self.files.select("path", "content"), "path")
        chunks = search.chunks(texts.select("path", search.embedding_text(F.col("path"), F.col("skeleton"), F.col("content")).alias("text")))
        return written(search.embedded(chunks, self.embedder), "embeddings")

    @cached_property
    def graph_rows(self) -> DataFrame:
        """The property graph of all files, a row a file."""
        return written(parsing.graph_rows(parsing.excluding(self.files, self.excluded)), "graph")

    @cached_property
    def calls(self) -> DataFrame:
        """Resolved calls of all files, from the rows of the property graph."""
        nodes, sites = (parsing.part_of(self.graph_rows, p) for p in ("nodes", "sites"))
        return written(calls.resolved_calls(sites, nodes, imports.bindings(self.resolved_imports), True), "calls")

    def _of_file(self, path: str, part: str) -> DataFrame:
        return parsing.part_of(parsing.graph_rows(self.files.filter(F.col("path") == path)), part)

    def functions(self, path: str) -> DataFrame:
        """Functions, methods and classes of a file."""
        return self._of_file(path, "nodes").filter(F.col("kind").isin("function", "method", "class")).orderBy("start_byte")

    def classes(self, path: str) -> DataFrame:
        return self.functions(path).filter("kind = 'class'")

    def children(self, path: str, node_id: str) -> DataFrame:
        """Nodes below a node of a file."""
        below = self._of_file(path, "edges").filter((F.col("kind") == "AstChild") & (F.col("src") == node_id)).select(F.col("dst").alias("node_id"))
        return self._of_file(path, "nodes").join(below, "node_id", "left_semi").orderBy("start_byte")

    def _of_function(self, path: str, name: str) -> DataFrame:
        """Statements, entry and exit of the functions of a name."""
        nodes = self._of_file(path, "nodes")
        owner = nodes.filter((F.col("name") == name) & F.col("kind").isin("function", "method")).select(F.col("node_id").alias("function_id"))
        return nodes.join(owner, "function_id", "left_semi")

    def statements(self, path: str, name: str) -> DataFrame:
        return self._of_function(path, name).filter("kind = 'statement'").orderBy("start_byte")

    def control_flow(self, path: str, name: str) -> DataFrame:
        """src, dst, kind of the control flow of the functions of a name, by the names of statements."""
        return self._edges_of_function(path, name, F.col("kind").startswith("ControlFlow"))

    def data_flow(self, path: str, name: str) -> DataFrame:
        """src, dst, kind, variable of definitions that reach a use in the functions of a name."""
        return self._edges_of_function(path, name, F.col("kind") == "DataFlowReach")

    def _edges_of_function(self, path: str, name: str, wanted) -> DataFrame:
        own = self._of_function(path, name).select("node_id", "name")
        edges = self._of_file(path, "edges").filter(wanted)
        ends = (own.select(F.col("node_id").alias(c), F.col("name").alias(f"{c}_name")) for c in ("src", "dst"))
        for end, c in zip(ends, ("src", "dst")):
            edges = edges.join(end, c)
        return edges.select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), "kind", "variable")

    def files_near(self, path: str, side: str) -> DataFrame:
        """The file and all its dependencies or dependents: a call graph needs these alone."""
        near = (graph.dependencies if side == "out" else graph.dependents)(self.edges, path).select("path")
        wanted = near.unionByName(self.files.sparkSession.createDataFrame([(path,)], "path string"))
        return self.files.join(wanted.distinct(), "path", "left_semi")

    def call_graph(self, files: DataFrame | None = None, instance_fallback: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(nodes, sites, resolved calls) of some files, or of all."""
        files = self.files if files is None else files
        rows = written(parsing.graph_rows(files), "graph")
        nodes, sites = (parsing.part_of(rows, p) for p in ("nodes", "sites"))
        return nodes, sites, calls.resolved_calls(sites, nodes, imports.bindings(self.resolved_imports), instance_fallback)

    # ---- the queries

    def status(self) -> DataFrame:
        waiting = self.unresolved().agg(F.count(F.lit(1)).alias("n_unresolved"))
        defined = self.symbols.filter("is_definition").agg(F.count_distinct("name").alias("n_defined_names"))
        tried = imports.counters(self.resolved_imports).agg(F.coalesce(F.sum("attempted"), F.lit(0)).alias("imports_attempted"), F.coalesce(F.sum("failed"), F.lit(0)).alias("imports_failed"))
        return graph.statistics(self.nodes, self.edges).crossJoin(waiting).crossJoin(defined).crossJoin(tried)

    def health(self) -> DataFrame:
        return graph.health(graph.statistics(self.nodes, self.edges))

    def unresolved(self) -> DataFrame:
        return graph.unresolved(self.import_targets, self.nodes)

    def repository_map(self, k: int = 50) -> str:
        return report.repository_map(self.nodes, self.ranks, self.edges, k)

    def dependencies(self, path: str) -> DataFrame:
        return graph.dependencies(self.edges, path)

    def dependents(self, path: str) -> DataFrame:
        return graph.dependents(self.edges, path)

    def top_ranked(self, k: int = 20) -> DataFrame:
        return rank.top_ranked(self.ranks, k)

    def _query(self, text: str) -> DataFrame:
        return self.files.sparkSession.createDataFrame([(0, self.embedder([text])[0])], "query_id int, embedding array<float>")

    def relevant(self, query: str, n: int = 10) -> DataFrame:
        found = search.candidates(self.chunk_embeddings, self._query(query), n).join(self.files.select("path", "content"), "path")
        return search.reranked(found, self.ranks, n, keep=~search.is_trivial_init(F.col("path"), F.col("content"))).drop("query_id").orderBy(F.desc("score"), "path")

    def context(self, query: str, model: str = "", budget: int | None = None, explicit: tuple[str, ...] = ()) -> str:
        if budget is None:
            budget = packing.token_budgets(self.files.sparkSession.createDataFrame([(model,)], "model string")).first().max_tokens
        files = self.nodes.select("path").join(self.skeletons, "path").join(self.files.select("path", "content"), "path")
        return packing.Packer(files, self.edges, self.ranks, self.chunk_embeddings).context(self._query(query), budget, self.repository_map(), explicit)

    def file_symbols(self, path: str) -> DataFrame:
        return parsing.formatted_symbols(parsing.cpg_nodes(self.files.filter(F.col("path") == path))).orderBy("start_line")

    def skeleton(self, path: str) -> str | None:
        row = parsing.skeletons(self.files.filter(F.col("path") == path)).first()
        return row.skeleton if row else None

    def callees(self, path: str, name: str) -> DataFrame:
        nodes, _, found = self.call_graph(self.files_near(path, "out"))
        return calls.callees(found, nodes, path, name)

    def callers(self, path: str, name: str) -> DataFrame:
        """Only files that depend on this one and name the function are parsed."""
        near = self.files_near(path, "in").filter((F.col("path") == path) | F.col("content").contains(name))
        nodes, _, found = self.call_graph(near)
        return calls.callers(found, nodes, path, name)

    #: Relations that a file has by itself: an update parses what changed alone. Those with True know partial trees.
    _PER_FILE = {"syntax": (parsing.checked, False), "symbols": (parsing.symbols, True), "raw_imports": (parsing.imports, True), "skeletons": (parsing.skeletons, False), "graph_rows": (parsing.graph_rows, True)}

    def update(self, changed: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
        """Takes changed (path, content) and deleted (path) files in; what edges that adds and removes.

        A changed file with a syntax error keeps its old text; a new one comes in with its sound parts.  Only these
        files are parsed; what joins make of all relations (edges, ranks, calls) is made anew, and equals what a
        fresh repository would have.
        """
        changed = written(changed.select("path", "content").join(parsing.checked(changed).select("path", "is_valid"), "path"), "changed")
        known = self.files.select("path")
        sound = changed.filter("is_valid").select("path", "content")
        partial = changed.filter("not is_valid").join(known, "path", "left_anti").select("path", "content")
        taken = sound.unionByName(partial)
        gone = taken.select("path") if deleted is None else taken.select("path").unionByName(deleted.select("path")).distinct()
        before, kept = self.edges, {}
        for name, (make, tolerant) in self._PER_FILE.items():
            if name in self.__dict__:
                own = (lambda df: parsing.excluding(df, self.excluded)) if name == "graph_rows" else (lambda df: df)
                fresh = make(own(sound)).unionByName(make(own(partial), partial=True)) if tolerant else make(taken)
                kept[name] = written(self.__dict__[name].join(small(gone), "path", "left_anti").unionByName(fresh), name)
        files = graph.upserted(self.files, taken)
        if deleted is not None:
            files = graph.removed(files, deleted)
        odd = partial.select("path") if self.tolerated is None else self.tolerated.join(gone, "path", "left_anti").unionByName(partial.select("path"))
        self.tolerated = written(odd, "tolerated")
        self.refresh(written(files, "files"))
        self.__dict__.update(kept)
        return graph.edge_differences(before, self.edges)

    def follow(self, events: DataFrame, checkpoint: str):
        """A query that applies a stream of change events (EVENTS) to this repository, batch by batch."""
        stream = changes.classified_stream(changes.relevant(events), self.files.select("path"))
        return changes.apply_changes(stream, lambda changed, deleted, _: self.update(changed, deleted), checkpoint)
