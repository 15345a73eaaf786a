"""A catalogue of declarative plans: each names the inputs it reads and is planned by Catalyst as a whole."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .dialect import DuckSql, SparkSql

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@dataclass
class Catalogue:
    """Shared views (name -> SQL over tables or earlier views) and the plans over them."""

    views: dict[str, Callable] = field(default_factory=dict)
    plans: dict[str, Callable] = field(default_factory=dict)
    plain_plans: dict[str, Callable] = field(default_factory=dict)

    def view(self, name: str):
        return lambda f: self.views.setdefault(name, f) and f

    def add(self, **plans: Callable) -> None:
        clash = plans.keys() & self.plans.keys()
        if clash:
            raise ValueError(f"plans named twice: {sorted(clash)}")
        self.plans |= plans

    def plain(self, **plans: Callable) -> None:
        """Plain statements of what a plan computes, however slow: the oracle's SQL in place of the plan's own."""
        unknown = plans.keys() - self.plans.keys()
        if unknown:
            raise ValueError(f"no such plans: {sorted(unknown)}")
        self.plain_plans |= plans

    def sql(self, name: str, dialect=SparkSql, plain: bool = False) -> str:
        """The plan with the views it reads as common table expressions."""
        known = self.plans | self.plain_plans if plain else self.plans
        body = known[name](dialect)
        used, todo = [], body
        for view in reversed(list(self.views)):
            text = f"{todo} {' '.join(t for _, t in used)}"
            if any(w.strip("(),;") == view for w in text.replace("(", " ( ").split()):
                used.append((view, self.views[view](dialect)))
        ctes = [f"{n} AS ({t})" for n, t in reversed(used)]
        body = body.strip()
        if not ctes:
            return body
        if body.upper().startswith("WITH "):
            return f"WITH {', '.join(ctes)}, {body[5:]}"
        return f"WITH {', '.join(ctes)} {body}"

    def run(self, spark: SparkSession, name: str, tables: Callable[[str], DataFrame]) -> DataFrame:
        """The plan over DataFrames: ``tables`` gives each base table (or a stand-in with its columns)."""
        return self._over(spark, self.sql(name), tables)

    def sql_views(self, *names: str, dialect=DuckSql) -> str:
        """The named views, and those they read, as the inside of a WITH clause."""
        used, text = [], " ".join(names)
        for view in reversed(list(self.views)):
            words = {w.strip("(),;") for w in (text + " " + " ".join(t for _, t in used)).replace("(", " ( ").split()}
            if view in words:
                used.append((view, self.views[view](dialect)))
        return ", ".join(f"{n} AS ({t})" for n, t in reversed(used))

    def view_frame(self, spark: SparkSession, name: str, tables: Callable[[str], DataFrame]) -> DataFrame:
        """One of the shared views as a DataFrame over the given tables."""
        return self._over(spark, f"WITH {self.sql_views(name, dialect=SparkSql)} SELECT * FROM {name}", tables)

    def run_frame(self, spark: SparkSession, text: str, tables: Callable[[str], DataFrame]) -> DataFrame:
        """SQL over the shared views, with the given tables below them."""
        views = self.sql_views(text, dialect=SparkSql)
        return self._over(spark, f"WITH {views} {text}" if views else text, tables)

    def _over(self, spark: SparkSession, text: str, tables: Callable[[str], DataFrame]) -> DataFrame:
        """``text`` over frames passed as arguments, so that no view of the session is touched."""
        words = {w.strip("(),;") for w in text.replace("(", " ( ").replace(",", " , ").split()}
        given = {t: tables(t) for t in TABLES if t in words}
        text = text.replace("{", "{{").replace("}", "}}")
        for t in given:
            text = re.sub(rf"(?i)\b(from|join)(\s+){t}\b", rf"\1\2{{{t}}}", text)
        return spark.sql(text, **given)

    def query(self, name: str) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: self.run(spark, name, lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

    def oracle(self, name: str) -> str:
        return self.sql(name, DuckSql, plain=True)


CATALOGUE = Catalogue()
