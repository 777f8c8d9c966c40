"""A stored entity graph that grows by batches of grounded documents.

A batch appends mentions and proposed edges as a unit; a repeat (a retried micro-batch, a job that lost
its driver) leaves the graph as it was.  Which entity a mention means is decided at reading, by rules that look at all mentions of a key at once: the same graph comes from any
cut of the documents into batches.

Mentions: key, kind (named, note or link), type, name, attrs, doc_id, seq.  One key has two entities at
most: a document (from notes) and another (from names; the first type wins, the best spelling is
shown, the first value of an attribute stays).  A link means the other entity, else the document, else
a placeholder concept.  Edges: doc_id, n, src, src_kind, rel, dst, dst_kind, valid_from, only_if.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import forms, text
from tessera.operators.graph import first_name_merges, relation_allowed, repointed
from tessera.operators.grounding import OWNER
from tessera.operators.stored import Batches

MENTIONS = "key string, kind string, type string, name string, attrs map<string,string>, doc_id string, seq long"
EDGES = "doc_id string, n long, src string, src_kind string, rel string, dst string, dst_kind string, valid_from date, only_if string"
OWNER_ID = "e_owner"


def fitted(rows: DataFrame, schema: str) -> DataFrame:
    """Columns of a schema, missing ones null."""
    parts = [c.split() for c in schema.replace("map<string,string>", "map").split(", ")]
    kinds = {name: "map<string,string>" if kind == "map" else kind for name, kind in parts}
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def entity_id(key: Column, is_document: Column) -> Column:
    return F.concat(F.lit("e_"), F.substring(F.sha2(F.concat(is_document.cast("string"), F.lit(":"), key), 256), 1, 16))


class GraphStore(Batches):
    def write(self, batch: int, mentions: DataFrame, edges: DataFrame) -> None:
        self.put(batch, {"mentions": fitted(mentions, MENTIONS), "edges": fitted(edges, EDGES)})

    def kinds(self) -> DataFrame:
        """For each key and kind of mention what all of its mentions make: type, best name, first seq.

        Mentions of a hot name are aggregated where they are read; three rows a key are left."""
        rows = self.get("mentions", MENTIONS)
        place = F.struct("batch", "seq", "doc_id")
        best = F.max_by("name", F.struct(text.name_rank(F.col("name")).alias("r"), (-F.col("batch")).alias("b"), (-F.col("seq")).alias("s")))
        return rows.groupBy("key", "kind").agg(F.min_by("type", place).alias("type"), best.alias("name"), F.count(F.lit(1)).alias("n_mentions"))

    def attributes(self) -> DataFrame:
        """key, kind and the first value of each attribute."""
        rows = self.get("mentions", MENTIONS).select("key", "kind", "batch", "seq", F.explode("attrs").alias("k", "v"))
        first = rows.groupBy("key", "kind", "k").agg(F.min_by("v", F.struct("batch", "seq")).alias("v"))
        return first.groupBy("key", "kind").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("attrs"))

    def resolved(self) -> DataFrame:
        """Entities before persons are merged: id, key, type, name, attrs, is_document, means_links, n_mentions."""
        kinds = self.kinds().join(self.attributes(), ["key", "kind"], "left")
        one = F.map_from_entries(F.collect_list(F.struct("kind", F.struct("type", "name", "attrs", "n_mentions"))))
        keyed = kinds.groupBy("key").agg(one.alias("of"))
        named, note, link = (F.try_element_at("of", F.lit(k)) for k in ("named", "note", "link"))
        none = F.create_map().cast("map<string,string>")

        def better(a: Column, b: Column) -> Column:
            """The linked spelling only where it ranks higher."""
            return F.when(text.name_rank(b) > text.name_rank(a), b).otherwise(a)

        def entity(row: Column, kind: Column, name: Column, attrs: Column, is_document: bool, links: Column) -> Column:
            mentions = F.coalesce(row["n_mentions"], F.lit(0)) + F.when(links, F.coalesce(link["n_mentions"], F.lit(0))).otherwise(0)
            return F.struct(kind.alias("type"), name.alias("name"), F.coalesce(attrs, none).alias("attrs"), F.lit(is_document).alias("is_document"), links.alias("means_links"), mentions.alias("n_mentions"))

        # a placeholder has no named mention; without a note it is what links of its key mean
        linked = F.create_map(F.lit("origin"), F.lit("link"))
        named_name = F.when(link.isNotNull() & (named["type"] != "DECISION"), better(named["name"], link["name"])).otherwise(named["name"])
        other = (
            F.when(named.isNotNull(), entity(named, named["type"], named_name, named["attrs"], False, F.lit(True)))
            .when(note.isNull() & link.isNotNull(), entity(named, F.lit("CONCEPT"), link["name"], linked, False, F.lit(True)))
        )
        note_name = F.when(link.isNotNull() & named.isNull(), better(note["name"], link["name"])).otherwise(note["name"])
        document = F.when(note.isNotNull(), entity(note, F.lit("DOCUMENT"), note_name, note["attrs"], True, named.isNull()))
        rows = keyed.select("key", F.inline(F.array_compact(F.array(other, document))))
        return rows.select(entity_id(F.col("key"), F.col("is_document")).alias("id"), "*")

    def merges(self, entities: DataFrame) -> DataFrame:
        """one_id and full_id of persons known by one word that mean the only full name with it."""
        people = entities.filter("type = 'PERSON'").select("id", "key")
        return first_name_merges(people)

    def edges(self, entities: DataFrame) -> DataFrame:
        """edge_id, src, rel, dst, valid_from, doc_id, n, closed: proposals whose ends and types fit what is stored,
        each once a document; an edge that a merge turned into a loop is closed."""
        rows = self.get("edges", EDGES)
        for end in ("src", "dst"):
            ids = entities.select(F.col("key").alias("__key"), F.col("id").alias(f"{end}_id"), F.col("type").alias(f"{end}_type"), "is_document", "means_links")
            wants = F.when(F.col(f"{end}_kind") == "link", F.col("means_links")).otherwise(F.col("is_document") == (F.col(f"{end}_kind") == "note"))
            rows = rows.join(ids, (F.col(end) == F.col("__key")) & (F.col(end) != OWNER) & wants, "left").drop("__key", "is_document", "means_links")
            own = F.col(end) == OWNER
            rows = rows.withColumns({f"{end}_id": F.when(own, OWNER_ID).otherwise(F.col(f"{end}_id")), f"{end}_type": F.when(own, "PERSON").otherwise(F.col(f"{end}_type"))})
        fits = F.col("src_id").isNotNull() & F.col("dst_id").isNotNull() & (F.col("src_id") != F.col("dst_id"))
        rows = rows.filter(fits & relation_allowed(F.col("rel"), F.col("src_type"), F.col("dst_type")))
        # a related target is only related if it isn't part of the project
        parts = rows.filter("only_if = 'part'").select(F.col("doc_id").alias("__doc"), F.col("src_id").alias("__part")).distinct()
        rows = rows.join(parts, (F.col("only_if") == "no part") & (F.col("doc_id") == F.col("__doc")) & (F.col("dst_id") == F.col("__part")), "left_anti")
        once = rows.groupBy("doc_id", F.col("src_id").alias("src"), "rel", F.col("dst_id").alias("dst")).agg(F.min("n").alias("n"), F.max("valid_from").alias("valid_from"))
        named = once.withColumn("edge_id", F.concat(F.lit("x_"), F.substring(F.sha2(F.concat_ws(":", "doc_id", "src", "rel", "dst"), 256), 1, 16)))
        return repointed(named.withColumn("closed", F.lit(False)), self.merges(entities))

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Entities (merged ones left out; attributes of both, the full name's first) and edges."""
        found = self.resolved()
        merges = self.merges(found)
        given = found.join(merges, found["id"] == merges["one_id"]).select(F.col("full_id").alias("__into"), F.explode("attrs").alias("k", "v"), "id")
        given = given.groupBy("__into", "k").agg(F.min_by("v", "id").alias("v")).groupBy("__into").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("__given"))
        entities = found.join(merges, found["id"] == merges["one_id"], "left_anti").join(given, found["id"] == given["__into"], "left")
        extra = F.map_filter(F.coalesce("__given", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys("attrs"), k))
        entities = entities.withColumn("attrs", F.map_concat("attrs", extra)).drop("__into", "__given")
        return entities, self.edges(found)


def named_mentions(kept: DataFrame) -> DataFrame:
    """Grounded entities (doc_id, n, pos, late, type, name, key, attrs) as mentions."""
    return kept.select("key", F.lit("named").alias("kind"), "type", "name", "attrs", F.col("doc_id").cast("string").alias("doc_id"), (F.col("n") * 1_000_000 + F.col("late") * 500_000 + F.col("pos")).cast("long").alias("seq"))


def named_edges(relations: DataFrame) -> DataFrame:
    """Grounded relations as edges between names."""
    return relations.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("n").cast("long").alias("n"), "src", F.lit("named").alias("src_kind"), "rel", "dst", F.lit("named").alias("dst_kind"), "valid_from")


def note_rows(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions and edges of notes (doc_id, path, n, text; a row a chunk): the note itself as a document, its links as
    mentioned in it and part of its project, the related ones related to the project, else to the note."""
    structure = forms.note_structure(F.col("text"))
    read = notes.select("doc_id", "n", text.note_title(F.col("path")).alias("title"), "path", text.links(F.col("text")).alias("links"), structure.alias("s"))
    whole = read.groupBy("doc_id", "title", "path").agg(
        F.min_by("s.project", F.when(F.col("s.project").isNotNull(), F.col("n"))).alias("project"),
        F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("n", F.col("s.related").alias("r")))), lambda x: x["r"]))).alias("related"),
    )
    key = lambda c: text.name_key(text.compatible(F.col(c)))
    linked = read.select("doc_id", "n", F.posexplode("links").alias("pos", "target"))
    first = linked.groupBy("doc_id", "target").agg(F.min(F.struct("n", "pos")).alias("at")).select("doc_id", "target", "at.*").withColumn("dst", key("target"))
    doc = whole.withColumn("doc_key", key("title"))
    seq = lambda n, pos, late: (n * 1_000_000 + late + pos).cast("long")
    document = doc.select(F.col("doc_key").alias("key"), F.lit("note").alias("kind"), F.lit("DOCUMENT").alias("type"), F.col("title").alias("name"), F.create_map(F.lit("path"), F.col("path")).alias("attrs"), "doc_id", F.lit(700_000).cast("long").alias("seq"))
    projects = doc.filter("project is not null").withColumn("key", key("project")).select("doc_id", "key", "project")
    links = first.select(F.col("dst").alias("key"), F.lit("link").alias("kind"), F.col("target").alias("name"), "doc_id", seq(F.col("n"), F.col("pos"), 800_000).alias("seq"))
    links = links.unionByName(projects.select("key", F.lit("link").alias("kind"), F.col("project").alias("name"), "doc_id", F.lit(750_000).cast("long").alias("seq")))
    mentions = fitted(document, MENTIONS).unionByName(fitted(links, MENTIONS))
    joined = first.join(doc.select("doc_id", "doc_key", "related"), "doc_id").join(projects.select("doc_id", F.col("key").alias("project_key")), "doc_id", "left")
    mentioned = joined.select("doc_id", "n", F.col("dst").alias("src"), F.lit("link").alias("src_kind"), F.lit("MENTIONED_IN").alias("rel"), F.col("doc_key").alias("dst"), F.lit("note").alias("dst_kind"))
    part = joined.filter("project_key is not null").select("doc_id", "n", F.col("dst").alias("src"), F.lit("link").alias("src_kind"), F.lit("PART_OF").alias("rel"), F.col("project_key").alias("dst"), F.lit("link").alias("dst_kind"), F.lit("part").alias("only_if"))
    is_related = F.array_contains("related", F.col("target"))
    related = joined.filter(is_related).select("doc_id", "n", F.coalesce("project_key", "doc_key").alias("src"), F.when(F.col("project_key").isNotNull(), "link").otherwise("note").alias("src_kind"), F.lit("RELATES_TO").alias("rel"), "dst", F.lit("link").alias("dst_kind"), F.lit("no part").alias("only_if"))
    edges = fitted(mentioned, EDGES).unionByName(fitted(part, EDGES)).unionByName(fitted(related, EDGES))
    return mentions, edges
