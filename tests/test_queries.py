"""Every registered query against its SQL, and the shape of those without."""

from __future__ import annotations

import hashlib
from pathlib import Path

import numpy as np
import pytest
from conftest import SMALL, rows

from tuneline.operators import stacked
from tuneline.plans import registry, views


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SMALL)) == rows(duck.sql(registry.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", ["O51_cv_evaluate_boosting", "O54_factor_scores", "O55_fit_surface", "O57_grid_search", "O59_surrogate_search", "O60_density_search", "O62_replica_pipeline"])
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_fingerprints_equal_hashlib(spark):
    found = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in registry.QUERIES["O08_table_fingerprints"](spark, SMALL).collect()}
    assert found == {f"{t}.parquet": hashlib.sha256(Path(SMALL, f"{t}.parquet").read_bytes()).hexdigest() for t in ("orders", "customer", "supplier")}


def test_components_equal_numpy(spark):
    rows = views.surface_input(spark, SMALL).toPandas()
    z = (rows[list("abcy")] - rows[list("abcy")].mean()) / rows[list("abcy")].std()
    vectors = np.linalg.eigh(np.corrcoef(z.T))[1][:, ::-1]
    got = registry.QUERIES["O35_pca_project"](spark, SMALL).toPandas()
    for j in range(3):
        own = z.to_numpy() @ vectors[:, j]
        assert np.allclose(np.sort(np.abs(got[f"PC{j + 1}"])), np.sort(np.abs(own)), atol=1e-6)


def test_logistic_evaluations_are_means_of_their_folds(spark):
    """The six configurations of O51 and the eight of O52: means that follow from the counts of single fits."""
    folds = registry._five(spark, SMALL)
    got = {r["config_id"]: r for r in registry.QUERIES["O51_cv_evaluate"](spark, SMALL).collect()}
    for i in (0, 4):
        fits = stacked.fit_logistic(folds, [{"config_id": i, "regParam": 0.1 * i, "elasticNetParam": 0.25 * (i % 3)}], 5)
        rows = folds.toPandas()
        x, y, fold = np.stack(rows["values"]), rows["label"].to_numpy(), rows["fold"].to_numpy()
        right = [((x[fold == f] @ fits.coef[f, 1:] + fits.coef[f, 0] > 0) == (y[fold == f] == 1)).mean() for f in range(5)]
        assert got[i]["Accuracy_Mean"] == pytest.approx(np.mean(right))
    assert len(got) == 6


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["method", "wins", "n", "win_rate"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
