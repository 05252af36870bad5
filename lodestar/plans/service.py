"""Requests against a registry and an index: what the endpoints of a search service do, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions.vector import vector_digest
from lodestar.operators import graph, ingest, search
from lodestar.operators.registry import Registry
from lodestar.sources.store import spooled


INDEX = "document_id string, pos int, text string, embedding array<float>, partition_id string, owner_id string"
INFO = "document_id string, name string, metadata binary, media_type string, tags array<string>, tags_embedding array<float>"


@dataclass(frozen=True)
class Service:
    """registry, index(document_id, pos, partition_id, text, embedding, owner_id) and info about documents (INFO). Changes give a new Service.

    fresh and fresh_info are the rows that the last change added to index and info.
    """

    registry: Registry
    index: DataFrame
    embedder: Callable = field(default=ingest.hashed_embedding)
    info: DataFrame | None = None
    fresh: DataFrame | None = None
    fresh_info: DataFrame | None = None

    @classmethod
    def empty(cls, spark: SparkSession, embedder: Callable = ingest.hashed_embedding) -> Service:
        e = lambda s: spark.createDataFrame([], s)
        registry = Registry(
            e("owner_id string, document_id string, group_id string"), e("document_id string, group_id string"),
            e("group_id string, owner_id string, label string, access string, tags array<string>"), e("document_id string, access string"),
        )
        return cls(registry, e(INDEX), embedder, e(INFO))

    # --- writing ------------------------------------------------------------------
    def ingest(self, inputs: DataFrame, owner: str, group_id: str | None = None, clean: bool = True, remove: str | None = None, media_type: str = "text", nobody: str = "local") -> tuple[Service, DataFrame]:
        """Index inputs (doc_id, text[, name, metadata, tags]) for an owner; (service, outcome counts with usage).

        What the owner has is skipped, what others have indexed gets a further
        owner, the rest is chunked, tagged, embedded with its tags and put. An
        input without text fails. ``remove`` is a document that goes as the new ones
        come. Without an owner it is ``nobody``, the name of this node.
        """
        owner = (owner or nobody).lower()
        has = inputs.where("text IS NOT NULL AND trim(text) <> ''")
        ids = ingest.content_ids(has).select("doc_id", "content_id")
        asked = ids.withColumn("owner_id", F.lit(owner)).withColumn("group_id", F.lit(group_id).cast("string"))
        links = self.registry.owner_document.select(F.col("document_id").alias("content_id"), "owner_id", "group_id")
        gated = spooled(ingest.gate(asked, self.index.select(F.col("document_id").alias("content_id")), links))
        todo = gated.where("action = 'index'").select("doc_id", "content_id")
        # of inputs that are one document the first is put
        todo = todo.groupBy("content_id").agg(F.min("doc_id").alias("doc_id"))
        fresh = has.join(todo.select("doc_id"), "doc_id", "left_semi")
        new = spooled(ingest.prepared(fresh, owner, self.embedder, clean))  # the model is asked once
        own_tags = F.col("tags") if "tags" in inputs.columns else F.lit(None).cast("array<string>")
        made = ingest.tags(has).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"]).alias("made"))
        given = has.select("doc_id", F.when(F.size(own_tags) > 0, own_tags).alias("given"))
        tags = given.join(made, "doc_id", "left").select("doc_id", F.coalesce("given", "made", F.array().cast("array<string>")).alias("tags"))
        tags = spooled(tags)
        extra = lambda c, kind: (F.col(c) if c in inputs.columns else F.lit(None)).cast(kind).alias(c)
        info = todo.join(has.select("doc_id", extra("name", "string"), extra("metadata", "binary")), "doc_id").join(tags, "doc_id")
        info = ingest.embed(info.withColumn("line", T.tag_string(F.col("tags"))), "line", self.embedder)
        info = spooled(info.select(F.col("content_id").alias("document_id"), "name", "metadata", F.lit(media_type).alias("media_type"), "tags", F.col("embedding").alias("tags_embedding")))
        # a group gets the tags of all that is put into it, new or linked
        row = lambda g: g.select("owner_id", F.col("content_id").alias("document_id"), "group_id", F.col("group_id").alias("label"), "tags", F.lit(None).cast("string").alias("access"))
        put = row(gated.where("action = 'index'").join(tags, "doc_id")).dropDuplicates(["document_id"])
        more = gated.where("action = 'link'").select("owner_id", F.col("content_id").alias("document_id"), "group_id").distinct()
        usage = new.agg(F.coalesce(ingest.usage(F.col("text")), F.lit(0)).cast("bigint").alias("tokens"))
        failed = inputs.where("text IS NULL OR trim(text) = ''").agg(F.count(F.lit(1)).alias("failed"))
        out = ingest.outcome(gated, failed).crossJoin(usage).withColumn("tokens", F.when(F.col("success"), F.col("tokens")).otherwise(0))
        after = replace(self, registry=self.registry.registered(put).linked(more), index=ingest.put(self.index, new), info=_replaced(self.info, info), fresh=new, fresh_info=info)
        if remove is not None:
            gone = self.index.sparkSession.createDataFrame([(remove,)], "document_id string")
            after = replace(after.removed(owner, gone), fresh=new, fresh_info=info)
        return after, out

    def indexed(self, items: DataFrame, owner: str, group_id: str | None = None, nobody: str = "local") -> Service:
        """Index items (document_id, text) under identifiers that the caller gives: no gate, no tags to be embedded, texts as they are; an item of several rows is chunks in order of pos."""
        owner = (owner or nobody).lower()
        pos = F.col("pos") if "pos" in items.columns else F.lit(0)
        rows = items.where("text IS NOT NULL AND text <> ''").select("document_id", pos.cast("int").alias("pos"), "text")
        rows = spooled(ingest.embed(rows, "text", self.embedder).where("size(embedding) > 0"))
        new = rows.select("document_id", "pos", "text", "embedding", vector_digest()(F.col("embedding"), F.col("document_id")).alias("partition_id"), F.lit(owner).alias("owner_id"))
        none = F.lit(None).cast("string")
        put = new.select(F.lit(owner).alias("owner_id"), "document_id", F.lit(group_id).cast("string").alias("group_id"), F.lit(group_id).cast("string").alias("label"), F.array().cast("array<string>").alias("tags"), none.alias("access")).distinct()
        return replace(self, registry=self.registry.registered(put), index=ingest.put(self.index, new), fresh=new, fresh_info=None)

    def removed(self, owner: str, documents: DataFrame) -> Service:
        """Unlink documents the owner has; what nobody has any more leaves the index. Registry.removal() says beforehand what will happen."""
        asked = documents.select(F.lit(owner).alias("owner_id"), "document_id").distinct()
        gone = self.registry.removal(asked).where("fully_removed").select("document_id")
        info = None if self.info is None else ingest.removed(self.info, gone)
        return replace(self, registry=self.registry.unlinked(asked), index=ingest.removed(self.index, gone), info=info, fresh=None, fresh_info=None)

    def without_owner(self, owner: str) -> Service:
        """Without all documents of an owner, and their groups."""
        gone = self.registry.owned(owner).where("fully_removed")
        info = None if self.info is None else ingest.removed(self.info, gone)
        return replace(self, registry=self.registry.without_owner(owner), index=ingest.removed(self.index, gone), info=info, fresh=None, fresh_info=None)

    def cleaned(self) -> Service:
        """Index without documents that nobody registered, registry without those that aren't indexed."""
        orphans = self.registry.orphans(self.index)
        index = ingest.removed(self.index, orphans)
        return replace(self, registry=self.registry.cleaned(index), index=index, fresh=None, fresh_info=None)

    def without_node(self, owner: str, partition_id: str) -> Service:
        """Delete a node, that is, its whole document, if the caller owns it."""
        return self.removed(owner, self.index.where(F.col("partition_id") == partition_id).select("document_id").distinct())

    def updated_group(self, owner: str, group_id: str, label: str = "", description: str = "", access: str = "") -> Service:
        r = self.registry.relabelled(owner, group_id, label, description)
        return replace(self, registry=r.with_group_access(owner, group_id, access) if access else r)

    def updated_document(self, owner: str, document_id, group_id: str = "", access: str = "") -> Service:
        r = self.registry.moved(owner, document_id, group_id) if group_id else self.registry
        return replace(self, registry=r.with_access(owner, document_id, access) if access else r)

    # --- reading ------------------------------------------------------------------
    def visible(self, owner: str, scope: str = "personal", groups: list[str] | None = None) -> DataFrame:
        r = self.registry
        docs = r.owner_document.where(F.col("owner_id") == owner).select("document_id")
        if scope == "global":
            docs = docs.union(r.document_access.where("access = 'available'").select("document_id"))
        if groups:
            docs = docs.join(r.document_group.where(F.col("group_id").isin(groups)), "document_id", "left_semi")
        return docs.distinct()

    def search(self, texts: list[str], owner: str, scope: str = "personal", groups: list[str] | None = None, k: int = search.K) -> DataFrame:
        """(query_id, rank, document_id, partition_id, distance, preview): exact top k over what the owner may see."""
        spark = self.index.sparkSession
        rows = [(i, [float(x) for x in v]) for i, v in enumerate(self.embedder(texts))]
        queries = spark.createDataFrame(rows, "query_id bigint, query array<float>")
        seen = self.index.join(self.visible(owner.lower(), scope, groups), "document_id", "left_semi")
        hits = search.candidates(seen, queries, k, (), ("document_id",))
        content = self.index.select("partition_id", T.preview(F.col("text")).alias("preview")).dropDuplicates(["partition_id"])
        return search.materialise(hits, content)

    def changed(self, other: Service, owner: str, group_id: str = "", document_id: str = "") -> bool:
        """Whether an update that led to ``other`` changed anything of the group or document."""
        a, b = self.registry, other.registry
        g, d = F.col("group_id") == group_id, F.col("document_id") == document_id
        pairs = [(a.groups.where(g), b.groups.where(g)), (a.document_group.where(d), b.document_group.where(d)), (a.document_access.where(d), b.document_access.where(d))]
        for x, y in pairs:
            if set(x.columns) != set(y.columns) or not (x.select(*y.columns).exceptAll(y).isEmpty() and y.exceptAll(x.select(*y.columns)).isEmpty()):
                return True
        return False

    def stats(self) -> DataFrame:
        return self.registry.totals().crossJoin(self.index.agg(F.count(F.lit(1)).alias("partitions")))

    # --- dispatch -----------------------------------------------------------------
    def dispatch(self, kind: str, **request):
        """A request of one of the kinds below; None for an unknown one."""
        r = self.registry
        kinds: dict[str, Callable] = {
            "search": self.search,
            "index": self.ingest,
            "remove": self.removed,
            "library": r.library,
            "library_page": r.page,
            "library_by_document": r.library_of_documents,
            "index_items": self.indexed,
            "remove_all": self.without_owner,
            "graph": lambda nodes, edges, **k: graph.neighbours(nodes, edges, **k),
            "hubs": graph.hubs,
            "delete_node": self.without_node,
            "update_group": self.updated_group,
            "update_document": self.updated_document,
            "stats": self.stats,
        }
        return kinds[kind](**request) if kind in kinds else None


def _replaced(old: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if old is None else old.join(new.select("document_id"), "document_id", "left_anti").unionByName(new)
