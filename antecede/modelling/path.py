"""From files to a submission in one call."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from antecede.modelling.metrics import log_loss, quadratic_kappa
from antecede.modelling.model import Learner, forest_learner, out_of_fold, submission
from antecede.modelling.prep import folds
from antecede.operators.frames import value_share
from antecede.operators.timeline import HOUR
from antecede.plans.eligibility import eligible_test, eligible_train, label_worlds, with_world
from antecede.plans.matrix import LABEL, feature_columns, test_matrix, train_matrix
from antecede.plans.roles import GAME, Roles
from antecede.session import materialize
from antecede.sources import read_events, read_labels, read_template, with_file_order, write_submission


@dataclass(frozen=True)
class Outcome:
    """Tables of one run: both matrices, every training row's score by the model that did not see it, how good those
    are (one row), the share of each predicted class, and the answer for each user of the template with their place in it."""

    train: DataFrame
    test: DataFrame
    held_out: DataFrame
    quality: DataFrame
    classes: DataFrame
    submission: DataFrame


def run_files(
    spark: SparkSession, train: str, labels: str, test: str, template: str, out: str | None = None, roles: Roles = GAME,
    k: int = 10, params: Mapping[str, object] | None = None, default: int | None = None, slot_seconds: int = HOUR,
    learner: Learner = forest_learner, at_once: int = 4,
) -> Outcome:
    """Reads the four CSV files, builds both matrices, fits ``k`` folds, scores, and writes ``out`` if given.

    The categories that become columns are those of the training log.  ``default`` is the class of users of the
    template that the test log does not have.  ``learner`` is a forest or, as ``boosted_learner(4)``, boosting that stops by
    the loss of each held-out fold.  The files written are in the template's order.
    """
    log = materialize(eligible_train(with_world(read_events(spark, train)), label_worlds(read_labels(spark, labels)), roles))
    roles = roles.observed(log)
    known = materialize(train_matrix(log, roles, slot_seconds))
    asked = materialize(eligible_test(with_world(read_events(spark, test)), roles))
    unknown = materialize(test_matrix(asked, roles, known.columns, slot_seconds=slot_seconds))
    placed = materialize(folds(known, LABEL, "game_session", k))
    held_out, averaged = out_of_fold(
        placed, feature_columns(roles), LABEL, "game_session", to_score=unknown, params=params, learner=learner, at_once=at_once
    )
    held_out = materialize(held_out)
    quality = quadratic_kappa(held_out, LABEL, "predicted").withColumn("log_loss", log_loss(held_out, LABEL).scalar())
    users = unknown.select("installation_id", "game_session").join(averaged, "game_session").select("installation_id", "scores")
    asked_users = with_file_order(read_template(spark, template), "place")
    answer = materialize(submission(users, asked_users, default=default, carry=["place"]))
    if out is not None:
        write_submission(answer, out, order=["place"])
    return Outcome(known, unknown, held_out, quality, value_share(held_out, "predicted"), answer)
