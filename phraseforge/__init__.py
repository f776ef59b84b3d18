"""phraseforge: keyphrase extraction, ranking and evaluation as Spark DataFrame jobs.

Every public function takes DataFrames (plus keyword parameters) and returns a
DataFrame.  Jobs that read one intermediate from several branches write it to
the shared checkpoint folder while they are built; the driver sees counts and
maxima, never rows.  Per-document work is partitioned by ``doc_id`` and
corpus-wide work (document frequency, n-gram statistics, similarity) is
expressed as joins and aggregations that Catalyst and AQE plan.
"""

from phraseforge.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
