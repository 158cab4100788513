"""Replica-log questions as plans over given tables: votes, commit index, log comparison, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vote_majority(votes: DataFrame, members: DataFrame) -> DataFrame:
    """votes(term, candidate, voter, granted), members(term, n) -> won per term and candidate.

    A voter counts once; a candidate's own vote is a vote like any other.
    """
    granted = votes.filter("granted").groupBy("term", "candidate").agg(F.count_distinct("voter").alias("granted"))
    return granted.join(members, "term").select("term", "candidate", "granted", (F.col("granted") >= F.floor(F.col("n") / 2) + 1).alias("won"))


def commit_index(matches: DataFrame, terms: DataFrame) -> DataFrame:
    """matches(leader, peer, match) with the leader's own last index as a row, terms(leader, first_index).

    The greatest index that a majority holds; first_index is where the leader's current term begins, and
    an index before it is not committed by counting (0 then).
    """
    ranked = matches.groupBy("leader").agg(F.sort_array(F.collect_list("match"), asc=False).alias("m"))
    held = ranked.select("leader", F.get("m", F.floor(F.size("m") / 2).cast("int")).alias("held"))
    return held.join(terms, "leader").select("leader", F.when(F.col("held") >= F.col("first_index"), F.col("held")).otherwise(F.lit(0)).cast("long").alias("commit_index"))


def up_to_date(requests: DataFrame) -> DataFrame:
    """Adds ok: whether a candidate's (last_term, last_index) is at or past the voter's own."""
    return requests.withColumn("ok", F.struct("last_term", "last_index") >= F.struct(F.col("own_term").alias("last_term"), F.col("own_index").alias("last_index")))


def votes_granted(requests: DataFrame) -> DataFrame:
    """Adds granted: term not older, no other vote in the term, and the log up to date."""
    free = F.col("voted_for").isNull() | (F.col("voted_for") == F.col("candidate")) | (F.col("term") > F.col("own_current"))
    return up_to_date(requests).withColumn("granted", (F.col("term") >= F.col("own_current")) & free & F.col("ok")).drop("ok")


def log_conflict(own: DataFrame, sent: DataFrame) -> DataFrame:
    """own, sent (node, log_index, term): the first index of each node whose terms differ (null: none)."""
    both = own.alias("o").join(sent.alias("s"), ["node", "log_index"])
    first = both.filter(F.col("o.term") != F.col("s.term")).groupBy("node").agg(F.min("log_index").alias("conflict_index"))
    return own.select("node").distinct().join(first, "node", "left")


def append_answers(own: DataFrame, nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(node, term, prev_index, prev_term, leader_commit), one a node, with ok and the node's new term.

    Refused: a term older than the node's, and an entry before the sent ones that the node does not hold
    with that term, which is also so for every gap.  Place 0 with term 0 is before the first entry.
    nodes(node, current_term, commit_index), own(node, log_index, term).
    """
    held = own.select("node", F.col("log_index").alias("prev_index"), F.col("term").alias("prev_term"), F.lit(True).alias("holds"))
    start = (F.col("prev_index") == 0) & (F.col("prev_term") == 0)
    both = requests.join(nodes, "node").join(held, ["node", "prev_index", "prev_term"], "left")
    ok = (F.col("term") >= F.col("current_term")) & (start | F.coalesce("holds", F.lit(False)))
    return both.select("node", F.greatest("term", "current_term").alias("term"), ok.alias("ok"), "prev_index", "leader_commit", "commit_index")


def append_entries(own: DataFrame, nodes: DataFrame, requests: DataFrame, sent: DataFrame) -> DataFrame:
    """The logs after each node's request: node, log_index, term; sent(node, log_index, term) from prev_index + 1 on."""
    answers = append_answers(own, nodes, requests)
    accepted = answers.filter("ok").select("node")
    return appended(own, sent.join(accepted, "node", "left_semi"))


def append_replies(own: DataFrame, nodes: DataFrame, requests: DataFrame, sent: DataFrame) -> DataFrame:
    """node, term, success, commit_index, last_index: a commit moves to the leader's, or the own log's end if that is less."""
    answers = append_answers(own, nodes, requests)
    ends = append_entries(own, nodes, requests, sent).groupBy("node").agg(F.max("log_index").alias("last_index"))
    both = answers.join(ends, "node", "left").withColumn("last_index", F.coalesce("last_index", F.lit(0)))
    moved = F.when(F.col("ok"), F.greatest("commit_index", F.least("leader_commit", "last_index"))).otherwise(F.col("commit_index"))
    return both.select("node", "term", F.col("ok").alias("success"), moved.cast("long").alias("commit_index"), F.col("last_index").cast("long").alias("last_index"))


def appended(own: DataFrame, sent: DataFrame) -> DataFrame:
    """The log after a leader's entries that the previous-entry test has let through: own entries up to the conflict, then the leader's; node, log_index, term."""
    cut = log_conflict(own, sent)
    kept = own.join(cut, "node").filter(F.col("conflict_index").isNull() | (F.col("log_index") < F.col("conflict_index"))).select("node", "log_index", "term")
    new = sent.select("node", "log_index", "term").join(kept.select("node", "log_index"), ["node", "log_index"], "left_anti")
    return kept.unionByName(new)


def applied(log: DataFrame, commits: DataFrame) -> DataFrame:
    """Committed entries not yet applied: log(node, log_index, ...), commits(node, last_applied, commit_index)."""
    return log.join(commits, "node").filter((F.col("log_index") > F.col("last_applied")) & (F.col("log_index") <= F.col("commit_index"))).drop("last_applied", "commit_index")
