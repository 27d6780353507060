"""One object over a folder of tables: every view of a ranking as a method that returns a DataFrame. It holds no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .config import Sliders, Weights
from .operators import chat, explain as X, matching as M, views as V
from .plans import entity, explain as PX, matching as PM, retrieval, texts, views as PV
from .session import table


class Engine:
    def __init__(self, spark: SparkSession, folder: str, weights: Weights = Weights()):
        self.spark, self.folder, self.weights = spark, folder, weights.normalised()

    def _t(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def _q(self, f) -> DataFrame:
        return f(self.spark, self.folder)

    def skills(self) -> DataFrame:
        return self._t("skill_ontology")

    def jobs(self) -> DataFrame:
        return self._t("jobs").drop("jd_text")

    def job(self, job_id: str) -> DataFrame:
        return self._t("jobs").where(F.col("job_id") == job_id)

    def audit(self) -> DataFrame:
        return self._q(texts.phrase_audit)

    def ranking(self) -> DataFrame:
        return self._q(PV.ranking)

    def rank(self) -> DataFrame:
        """The fused ranking under this engine's weights."""
        scored = PM._features(self.spark, self.folder).withColumn("score", PM._score(self.weights))
        return M.final_rank(scored)

    def reweighted(self, **knobs: float) -> "Engine":
        """Another engine; knobs that aren't named go back to their defaults."""
        return Engine(self.spark, self.folder, Sliders().moved(**knobs).weights())

    def filter(self, **filters) -> DataFrame:
        return V.filtered(self.ranking(), PV.flags(self.spark, self.folder), PM.have(self.spark, self.folder), **filters)

    def matrix(self) -> DataFrame:
        return self._q(PV.skill_matrix)

    def coverage(self) -> DataFrame:
        return self._q(PV.pool_coverage)

    def compare(self, n: int = 3) -> DataFrame:
        return V.pairwise(self.ranking(), PM._tiers(self.spark, self.folder), max(2, min(n, 10)))

    def candidate(self, who: str) -> DataFrame:
        return V.find(self.ranking(), who)

    def flags(self) -> DataFrame:
        return PV.flags(self.spark, self.folder)

    def timeline(self) -> DataFrame:
        return self._q(texts.timeline_entries)

    def duplicates(self) -> DataFrame:
        return self._q(entity.identity_groups)

    def collapsed(self) -> DataFrame:
        return self._q(PV.collapse_renumber)

    def bm25(self) -> DataFrame:
        return self._q(retrieval.bm25_rank)

    def dashboard(self) -> DataFrame:
        return self._q(PV.dashboard)

    def explain(self, n: int = 3) -> DataFrame:
        """The explanations of the first n of each job."""
        return PX.explained(self.spark, self.folder, self.ranking().where(F.col("rank") <= n))

    def why_above(self, a: int = 1, b: int = 2) -> DataFrame:
        """Why the candidate of the better of two ranks stands above the other, per job."""
        a, b = sorted((a, b))
        s = PX._sides(self.spark, self.folder, self.ranking().where(F.col("rank").isin(a, b)))
        x, y = s.where(F.col("rank") == a).select("job_id", F.col("x").alias("a")), s.where(F.col("rank") == b).select("job_id", F.col("x").alias("b"))
        return x.join(y, "job_id").select("job_id", X.comparison(F.col("a"), F.col("b")).alias("text"))

    def rerank_with(self, *skills: str) -> DataFrame:
        return PM.rerank_with(self.spark, self.folder, list(skills)).orderBy(F.abs("delta").desc(), "job_id", "now")

    def parsed(self) -> DataFrame:
        return self._q(texts.parsed_record)

    def csv(self) -> DataFrame:
        return self._q(PX.csv_rows)

    def ask(self, question: str) -> tuple[str, DataFrame | None]:
        """The question's intent and the view that answers it; the skills, years, number and ranks it states are used."""
        q = chat.parsed(self.spark.createDataFrame([(0, question)], "id int, q string"), "id", "q", self.skills()).first()
        named, refs = tuple(q["asked"]), q["refs"]
        owned = lambda: PM.have(self.spark, self.folder).where(F.col("skill_key").isin(*named)).groupBy("resume_id").agg(F.count("*").alias("matched"))
        bounds = {"max_years" if q["at_most"] else "min_years": q["years"]} if q["years"] is not None else {}
        answers = {
            "compare": lambda: self.why_above(refs[0], refs[1]) if len(refs) > 1 else self.compare(), "flags": self.flags, "gaps": lambda: self.coverage().where("kind = 'required'").orderBy("pct"),
            "who_has": lambda: self.ranking().join(owned(), "resume_id").orderBy("job_id", F.col("matched").desc(), "rank"),
            "who_lacks": lambda: self.ranking().join(owned().where(F.col("matched") == len(named)), "resume_id", "left_anti"),
            "filter": lambda: self.filter(must_have=named, freshers_only=q["beginners"], **bounds), "confidence": lambda: self.ranking().orderBy(F.col("confidence").desc_nulls_last()), "best": lambda: self.explain(q["n"]),
            "explain": lambda: PX.explained(self.spark, self.folder, self.ranking().where(F.col("rank") == refs[0])) if refs else self.explain(), "add_requirement": lambda: self.rerank_with(*named),
        }
        view = answers.get(q["intent"])
        return q["intent"], view() if view else None
