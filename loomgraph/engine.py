"""One object over the tables of a group: every call returns a DataFrame, and reads only what its caller may see."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as X
from .operators import aggregates as A
from .operators import clusters as C
from .operators import extraction as E
from .operators import graph as G
from .operators import memory as M
from .operators import temporal as T
from .plans import answers, retrieval as R
from .security import Access, simulate, visible_rows
from .storage import insert_if_absent, of_group, upsert, written


@dataclass(frozen=True)
class Engine:
    """The tables of one group, and who asks.  Writes return a new engine; storing its tables is the caller's."""

    entities: DataFrame
    facts: DataFrame
    episodes: DataFrame
    memory: DataFrame
    aliases: DataFrame
    relations: DataFrame
    access: Access | None = None
    group_id: str | None = None

    def for_group(self, group_id: str) -> Engine:
        """The same tables with the rows of one tenant only; the relations of the default group are shared."""
        own = {n: of_group(getattr(self, n), group_id, n == "relations") for n in ("entities", "facts", "episodes", "memory", "aliases", "relations")}
        return replace(self, group_id=group_id, **own)

    def seen_by(self, access: Access | None) -> Engine:
        return replace(self, access=access)

    @property
    def corpus(self) -> R.Corpus:
        return R.Corpus(self.entities, self.facts, self.episodes, self.aliases)

    # reads

    def search(self, query: str, **options) -> DataFrame:
        return R.search(self.corpus, R.Request(query, access=self.access, **options))

    def answer(self, query: str, relevant: Callable[[DataFrame], DataFrame] | None = None, coverage: tuple[str, ...] = (), **options) -> answers.Answer:
        return answers.answer(self.corpus, self.memory, R.Request(query, access=self.access, **options), relevant, coverage)

    def trace(self, query: str, **options) -> dict[str, DataFrame]:
        return answers.trace(self.corpus, self.memory, R.Request(query, access=self.access, **options))

    def search_memory(self, query: str, **options) -> DataFrame:
        return M.memory_search(self.memory, query, self.access, **options)

    def list_memory(self, **options) -> DataFrame:
        return M.memory_list(self.memory, self.access, **options)

    def get_entity(self, entity_id: str) -> DataFrame:
        return visible_rows(self.entities.filter(F.col("id") == entity_id), self.access)

    def find_entity(self, name: str, least: float = 0.3, limit: int = 10) -> DataFrame:
        """Entities whose name is like this one, the most similar first."""
        rows = visible_rows(self.entities, self.access).withColumn("similarity", X.similarity(F.col("name"), F.lit(name)))
        return rows.filter(F.col("similarity") > least).orderBy(F.desc("similarity"), "id").limit(limit)

    def get_facts(self, **options) -> DataFrame:
        return T.get_facts(self.facts, self.access, **options)

    def as_of(self, ts, **options) -> DataFrame:
        return T.as_of(self.facts, self.entities, ts, self.access, **options)

    def changed_since(self, since, **options) -> DataFrame:
        return T.changed_since(self.facts, self.entities, since, self.access, **options)

    def timeline(self, entity_id: str, **options) -> DataFrame:
        return T.entity_timeline(self.facts, self.entities, entity_id, self.access, **options)

    def related(self, entity_id: str, depth: int = 1, limit: int | None = 50) -> DataFrame:
        return G.related(G.edges_of(self.facts, self.entities, self.access), entity_id, limit, depth)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and links for export."""
        nodes = A.graph_nodes(visible_rows(self.entities, self.access), visible_rows(self.facts, self.access))
        return nodes, A.graph_links(visible_rows(self.facts, self.access), nodes)

    def simulate_permission(self, access: Access | None) -> DataFrame:
        return self.entities.select("id", simulate("visibility", access).alias("s")).select("id", "s.*")

    def entity_clusters(self, least: float = 0.82) -> DataFrame:
        return C.entity_clusters(visible_rows(self.entities, self.access), self.aliases, least)

    def relation_clusters(self, least: float = 0.78) -> DataFrame:
        return C.relation_clusters(visible_rows(self.facts, self.access), least)

    def expired_episodes(self, now, **options) -> DataFrame:
        """Ephemeral episodes past their time that nothing rests on."""
        return T.cleanup_candidates(self.episodes, self.facts, self.memory, now, **options)

    def canonical_clusters(self, least: float = 0.82) -> DataFrame:
        """Entities of one type with equal or like names: id, the cluster's canonical id, and the band of its weakest pair."""
        names = visible_rows(self.entities, self.access).select("id", "entity_type", "name")
        same = G.name_members(names).filter("id <> representative").select(F.col("representative").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"))
        pairs = written(G.similar_names(names, least).unionByName(same), "pairs")
        both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")))
        found = G.components(both.select(F.col("src").alias("id")).distinct(), both)
        weakest = pairs.join(found, F.col("a") == F.col("id")).groupBy("label").agg(F.min("score").alias("score"))
        return found.join(weakest, "label").select("id", F.col("label").alias("canonical"), G.canonical_band(F.col("score")).alias("band"))

    # reports over a log of extractions, reviews and evaluations

    @staticmethod
    def extraction_stats(log: DataFrame, since) -> DataFrame:
        return A.extraction_stats(log, since)

    @staticmethod
    def suggested_patterns(log: DataFrame, **options) -> DataFrame:
        return A.top_patterns(log, **options)

    @staticmethod
    def improvement_proposals(extracted: DataFrame, reviews: DataFrame) -> DataFrame:
        return A.improvement_proposals(extracted, reviews)

    @staticmethod
    def run_evals(answers_: DataFrame, **options) -> DataFrame:
        return M.eval_scores(answers_, **options)

    # writes

    def ingest_batch(self, episodes: DataFrame, entities: DataFrame, facts: DataFrame) -> E.Batch:
        """What a batch of episodes and their extractions adds to the tables."""
        stored = {"episodes": self.episodes, "entities": self.entities, "aliases": self.aliases, "facts": self.facts}
        return E.ingest_batch(stored, episodes, entities, facts, self.relations)

    def delete_expired(self, now, **options) -> Engine:
        gone = self.expired_episodes(now, **options).select("id")
        return replace(self, episodes=self.episodes.join(gone, "id", "left_anti"))

    def ingest(self, episodes: DataFrame) -> Engine:
        return replace(self, episodes=insert_if_absent(self.episodes, episodes, ["source_type", "source_id"], "valid_at"))

    def assert_facts(self, facts: DataFrame) -> Engine:
        """New facts take their place among the old ones under the relations' policies; facts of a known id are not new."""
        fresh = facts.join(self.facts.select("id"), "id", "left_anti")
        return replace(self, facts=T.supersede(self.facts.unionByName(fresh), self.relations))

    def define_relations(self, relations: DataFrame) -> Engine:
        return replace(self, relations=upsert(self.relations, relations, ["id"]))

    def merge(self, mapping: DataFrame) -> Engine:
        gone = mapping.select(F.col("duplicate").alias("id"))
        return replace(self, facts=G.merge_entities(self.facts, mapping), entities=self.entities.join(gone, "id", "left_anti"))
