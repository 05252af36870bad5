"""Ownership, groups and access as tables; queries over them and set-based changes."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Registry:
    """owner_document(owner_id, document_id, group_id): group_id is the owner's primary group of the document.
    document_group(document_id, group_id); groups(group_id, owner_id, label, access, tags); document_access(document_id, access).

    Each change gives a new Registry; the tables of an old one stay as they are.
    """

    owner_document: DataFrame
    document_group: DataFrame
    groups: DataFrame
    document_access: DataFrame

    @classmethod
    def of(cls, views) -> Registry:
        tags = F.array(F.lit("tag"), F.col("owner_id"))
        return cls(
            views.document_group.select("owner_id", "document_id", "group_id"),
            views.document_group.select("document_id", "group_id").distinct(),
            views.group.withColumn("tags", tags),
            views.document_access,
        )

    # --- queries ------------------------------------------------------------------
    def totals(self) -> DataFrame:
        one = lambda df, c: df.agg(F.count_distinct(c).alias(c))
        known = self.document_access.where("access <> 'unknown'")
        return (
            one(known.select(F.col("document_id").alias("documents")), "documents")
            .crossJoin(one(self.groups.select(F.col("group_id").alias("groups")), "groups"))
            .crossJoin(one(self.owner_document.select(F.col("owner_id").alias("owners")), "owners"))
            .crossJoin(one(known.where("access = 'available'").select(F.col("document_id").alias("available")), "available"))
        )

    def library(self, owner: str, earnings: DataFrame | None = None, include_available: bool = False) -> DataFrame:
        """(group_id, label, owner_id, access, documents, total_earnings) of the owner's groups, then available ones of others."""
        own = self.groups.where(F.col("owner_id") == owner)
        if include_available:
            own = own.unionByName(self.groups.where("access = 'available'")).dropDuplicates(["group_id"])
        return self.built(own, earnings)

    def library_of_documents(self, documents: DataFrame, earnings: DataFrame | None = None) -> DataFrame:
        """Every group of the documents, without looking at owner or access."""
        ids = self.document_group.join(documents.select("document_id").distinct(), "document_id", "left_semi").select("group_id").distinct()
        return self.built(self.groups.join(ids, "group_id", "left_semi"), earnings)

    def built(self, groups: DataFrame, earnings: DataFrame | None) -> DataFrame:
        """Groups with their documents, in order, and what these earned; a group without owner is left out."""
        links = self.document_group
        if earnings is not None:
            links = links.join(earnings, "document_id", "left")
        else:
            links = links.withColumn("earned", F.lit(0.0))
        per = links.groupBy("group_id").agg(F.array_sort(F.collect_set("document_id")).alias("documents"), F.sum(F.coalesce("earned", F.lit(0.0))).alias("total_earnings"))
        return groups.where("owner_id IS NOT NULL").join(per, "group_id", "left").select(
            "group_id", "label", "owner_id", "access", F.coalesce("documents", F.array().cast(f"array<{dict(self.document_group.dtypes)['document_id']}>")).alias("documents"), F.coalesce("total_earnings", F.lit(0.0)).alias("total_earnings")
        )

    def page(self, owner: str, after: str | None, limit: int, include_available: bool = False) -> DataFrame:
        """(group_id, owner_id, has_more): entries after the cursor in order of identifier; limit 0 means all."""
        rows = self.groups.where(F.col("owner_id") == owner)
        if include_available:
            rows = rows.unionByName(self.groups.where((F.col("access") == "available") & (F.col("owner_id") != owner)))
        rows = rows.where(F.col("group_id") > after) if after is not None else rows
        rows = rows.select("group_id", "owner_id")
        if not limit:
            return rows.withColumn("has_more", F.lit(False))
        top = rows.orderBy("group_id").limit(limit + 1)
        numbered = top.withColumn("n", F.row_number().over(W.orderBy("group_id"))).withColumn("has_more", F.max("n").over(W.partitionBy()) > limit)
        return numbered.where(F.col("n") <= limit).drop("n")

    def co_owners(self) -> DataFrame:
        """(document_id, owners): documents with more than one owner, own or through a group."""
        through = self.document_group.join(self.groups.select("group_id", "owner_id"), "group_id").select("owner_id", "document_id")
        both = self.owner_document.select("owner_id", "document_id").union(through)
        return both.groupBy("document_id").agg(F.array_sort(F.collect_set("owner_id")).alias("owners")).where("size(owners) > 1")

    # --- changes ------------------------------------------------------------------
    def with_access(self, owner: str, document_id: int, access: str) -> Registry:
        """Set a document's access, if the caller owns it."""
        ok = self.owner_document.where((F.col("owner_id") == owner) & (F.col("document_id") == document_id)).select("document_id").distinct().withColumn("__new", F.lit(access))
        return replace(self, document_access=self._set(self.document_access, ok))

    def with_group_access(self, owner: str, group_id: str, access: str) -> Registry:
        """Set a group's access and that of all its documents, if the caller owns the group."""
        own = (F.col("owner_id") == owner) & (F.col("group_id") == group_id)
        hit = self.document_group.join(self.groups.where(own).select("group_id"), "group_id", "left_semi").select("document_id").distinct().withColumn("__new", F.lit(access))
        groups = self.groups.withColumn("access", F.when(own, F.lit(access)).otherwise(F.col("access")))
        return replace(self, groups=groups, document_access=self._set(self.document_access, hit))

    @staticmethod
    def _set(table: DataFrame, new: DataFrame) -> DataFrame:
        return table.join(new, "document_id", "left").select("document_id", F.coalesce("__new", "access").alias("access"))

    def unlinked(self, links: DataFrame) -> Registry:
        """Drop (owner_id, document_id) links: the document leaves the owner's primary group; with its last owner everything of it goes. Groups stay, empty or not."""
        gone = self.owner_document.join(links, ["owner_id", "document_id"], "left_semi")
        left = self.owner_document.join(links, ["owner_id", "document_id"], "left_anti")
        alive = left.select("document_id").distinct()
        member = self.document_group.join(gone.select("document_id", "group_id"), ["document_id", "group_id"], "left_anti").join(alive, "document_id", "left_semi")
        return replace(self, owner_document=left, document_group=member, document_access=self.document_access.join(alive, "document_id", "left_semi"))

    def removal(self, links: DataFrame) -> DataFrame:
        """(owner_id, document_id, authorised, fully_removed) of removals that are asked for: whether the caller owns the document, and whether nobody has it afterwards."""
        own = self.owner_document.select("owner_id", "document_id").distinct().withColumn("own", F.lit(True))
        asked = links.select("owner_id", "document_id").distinct().join(own, ["owner_id", "document_id"], "left")
        left = self.unlinked(links).owner_document.select("document_id").distinct().withColumn("left", F.lit(True))
        out = asked.join(left, "document_id", "left")
        ok = F.coalesce("own", F.lit(False))
        return out.select("owner_id", "document_id", ok.alias("authorised"), (ok & F.col("left").isNull()).alias("fully_removed"))

    def owned(self, owner: str) -> DataFrame:
        """(document_id, fully_removed): all documents of an owner, and whether they go with them."""
        mine = self.owner_document.where(F.col("owner_id") == owner).select("owner_id", "document_id").distinct()
        return self.removal(mine).select("document_id", "fully_removed")

    def cleaned(self, indexed: DataFrame) -> Registry:
        """Without documents that aren't indexed any more: their links, memberships and access go, groups stay."""
        there = indexed.select("document_id").distinct()
        keep = lambda df: df.join(there, "document_id", "left_semi")
        return replace(self, owner_document=keep(self.owner_document), document_group=keep(self.document_group), document_access=keep(self.document_access))

    def without_owner(self, owner: str) -> Registry:
        """Drop all links of an owner, and the groups they own."""
        after = self.unlinked(self.owner_document.where(F.col("owner_id") == owner).select("owner_id", "document_id"))
        keep = self.groups.where(F.col("owner_id") != owner)
        return replace(after, groups=keep, document_group=after.document_group.join(keep.select("group_id"), "group_id", "left_semi"))

    def moved(self, owner: str, document_id: int, group_id: str) -> Registry:
        """Put an owner's document into another of their groups; neither access changes."""
        mine = (F.col("owner_id") == owner) & (F.col("document_id") == document_id)
        target = self.groups.where((F.col("owner_id") == owner) & (F.col("group_id") == group_id)).select("group_id")
        was = self.owner_document.where(mine).join(target.withColumnRenamed("group_id", "__to")).select("document_id", "group_id", "__to")
        kept = self.document_group.join(was.select("document_id", "group_id"), ["document_id", "group_id"], "left_anti")
        member = kept.union(was.select("document_id", F.col("__to").alias("group_id"))).distinct()
        links = self.owner_document.join(was.select("document_id", "__to"), "document_id", "left")
        links = links.select("owner_id", "document_id", F.when(mine & F.col("__to").isNotNull(), F.col("__to")).otherwise(F.col("group_id")).alias("group_id"))
        return replace(self, owner_document=links, document_group=member)

    def registered(self, new: DataFrame) -> Registry:
        """Register (owner_id, document_id, group_id, label, tags, access) rows, in order of seq if there is such a column.

        A group takes effect if nobody or the caller owns it: the document joins
        it and takes its stored access, tags are united. Of several owners who claim
        a group that nobody has, the first gets it, with that row's label and access.
        Where a group has no effect, and without a
        group, the document becomes restricted, even if it was available before. Of several rows of a document the last decides.
        """
        seq = F.col("seq") if "seq" in new.columns else F.monotonically_increasing_id()
        new = new.withColumn("__seq", seq)
        holder = self.groups.select("group_id", F.col("owner_id").alias("__holder"), F.col("access").alias("__access"))
        first = F.min_by(F.struct("owner_id", "label", F.coalesce("access", F.lit("restricted")).alias("access")), F.struct("__seq", "owner_id")).alias("f")
        claims = new.where("group_id IS NOT NULL").join(holder.select("group_id"), "group_id", "left_anti").groupBy("group_id").agg(first)
        fresh = claims.select("group_id", "f.owner_id", "f.label", "f.access")
        n = new.join(holder.unionByName(fresh.select("group_id", F.col("owner_id").alias("__holder"), F.col("access").alias("__access"))), "group_id", "left")
        n = n.withColumn("__ok", F.col("group_id").isNotNull() & (F.col("__holder") == F.col("owner_id")))
        n = n.withColumn("__ok", F.coalesce("__ok", F.lit(False)))
        more = n.where("__ok AND size(tags) > 0").groupBy("group_id").agg(F.flatten(F.collect_list("tags")).alias("__more"))
        every = self.groups.unionByName(fresh.withColumn("tags", F.array().cast("array<string>")), allowMissingColumns=True)
        united = F.when(F.col("__more").isNull(), F.col("tags")).otherwise(F.array_sort(F.array_union(F.coalesce("tags", F.array().cast("array<string>")), "__more")))
        groups = every.join(more, "group_id", "left").withColumn("tags", united).drop("__more")
        # of an owner's rows for a document the last with a group decides which is the primary one
        link = n.groupBy("owner_id", "document_id").agg(F.max_by("group_id", F.when(F.col("__ok"), F.col("__seq"))).alias("__g"))
        both = self.owner_document.join(link, ["owner_id", "document_id"], "full")
        links = both.select("owner_id", "document_id", F.coalesce("__g", "group_id").alias("group_id"))
        member = self.document_group.union(n.where("__ok").select("document_id", "group_id")).distinct()
        access = F.when(F.col("__ok"), F.coalesce("__access", F.lit("restricted"))).otherwise(F.lit("restricted"))
        put = n.groupBy("document_id").agg(F.max_by(access, F.struct("__seq", access)).alias("__new"))
        table = self.document_access.join(put, "document_id", "full").select("document_id", F.coalesce("__new", "access").alias("access"))
        return Registry(links, member, groups, table)

    def linked(self, new: DataFrame) -> Registry:
        """Give (owner_id, document_id, group_id) rows a further owner; a group of somebody else's is ignored, a primary group there is stays, access isn't touched."""
        holder = self.groups.select("group_id", F.col("owner_id").alias("__holder"))
        n = new.join(holder, "group_id", "left").withColumn("__g", F.when(F.col("__holder").isNull() | (F.col("__holder") == F.col("owner_id")), F.col("group_id")))
        known = self.owner_document.join(n.select("owner_id", "document_id", "__g"), ["owner_id", "document_id"], "left").select("owner_id", "document_id", F.coalesce("group_id", "__g").alias("group_id"))
        links = known.union(n.join(self.owner_document, ["owner_id", "document_id"], "left_anti").select("owner_id", "document_id", "__g")).distinct()
        fresh = n.where("__g IS NOT NULL AND __holder IS NULL").select("group_id", "owner_id").distinct()
        member = self.document_group.union(n.where("__g IS NOT NULL").select("document_id", F.col("__g"))).distinct()
        return replace(self, owner_document=links, document_group=member, groups=self.groups.unionByName(fresh, allowMissingColumns=True))

    def relabelled(self, owner: str, group_id: str, label: str | None = None, description: str | None = None) -> Registry:
        """Rename a group the caller owns; an empty value changes nothing."""
        mine = (F.col("owner_id") == owner) & (F.col("group_id") == group_id)
        groups = self.groups
        for name, value in (("label", label), ("description", description)):
            if value:
                old = F.col(name) if name in groups.columns else F.lit(None).cast("string")
                groups = groups.withColumn(name, F.when(mine, F.lit(value)).otherwise(old))
        return replace(self, groups=groups)

    def without_groups(self, owner: str, group_ids: list[str]) -> Registry:
        """Delete groups the caller owns; their documents stay."""
        gone = (F.col("owner_id") == owner) & F.col("group_id").isin(group_ids)
        keep = self.groups.where(~gone)
        return replace(self, groups=keep, document_group=self.document_group.join(keep.select("group_id"), "group_id", "left_semi"))

    # --- repair -------------------------------------------------------------------
    def orphans(self, indexed: DataFrame) -> DataFrame:
        """Indexed documents nobody registered."""
        return indexed.select("document_id").distinct().join(self.document_access.where("access <> 'unknown'"), "document_id", "left_anti")

    def lost(self, indexed: DataFrame) -> DataFrame:
        """Registered documents that aren't indexed."""
        return self.document_access.select("document_id").join(indexed.select("document_id").distinct(), "document_id", "left_anti")

    def valid_groups(self, claims: DataFrame) -> DataFrame:
        """Claims (group_id, owner_id) that agree with the groups' owners."""
        return claims.join(self.groups, ["group_id", "owner_id"], "left_semi")


def accumulated(stats: DataFrame, delta: DataFrame, key: str | list[str], sums: list[str], last: str | None = None, seq: str | None = None) -> DataFrame:
    """Add to counters by key, making missing rows; ``last`` takes the latest non-null value by ``seq``, not the greatest."""
    rows = stats.unionByName(delta, allowMissingColumns=True)
    aggs: list[Column] = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in sums]
    if last:
        aggs.append(F.max_by(last, F.when(F.col(last).isNotNull(), F.col(seq))).alias(last))
    return rows.groupBy(*([key] if isinstance(key, str) else key)).agg(*aggs)


def accumulated_partitions(stats: DataFrame, delta: DataFrame) -> DataFrame:
    """Counters of partitions, (document_id, partition_id, retrievals, sentiment, last_retrieved, seq), added up; of last_retrieved the latest non-null by seq."""
    return accumulated(stats, delta, ["document_id", "partition_id"], ["retrievals", "sentiment"], "last_retrieved", "seq")


def nested(partitions: DataFrame) -> DataFrame:
    """(document_id, counts, sentiments): a document's partition counters as maps."""
    entry = lambda v: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("partition_id").alias("key"), v.alias("value")))))
    return partitions.groupBy("document_id").agg(entry(F.col("retrievals")).alias("counts"), entry(F.struct("retrievals", "sentiment", "last_retrieved")).alias("sentiments"))
