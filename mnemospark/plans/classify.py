"""One classify pass: replies in, facts, work state and audit rows out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from mnemospark.operators import facts, state
from mnemospark.schemas import DEFAULTS
from mnemospark.session import cut_lineage


@dataclass
class ClassifyPass:
    documents: DataFrame
    entries: DataFrame
    links: DataFrame
    outcomes: DataFrame
    rejects: DataFrame
    audit: DataFrame


def classify_pass(docs: DataFrame, entries: DataFrame, replies: DataFrame, correlation_id: Column, now: str | None = None, retries: int = DEFAULTS.classify_retries) -> ClassifyPass:
    """Validate ``replies(reply_id, doc_id, dimension, raw)``, apply their actions and settle the documents' work state.

    A document is done when every reply about it was accepted and named known entries only; an
    accepted reply without any action counts as done. Otherwise its attempts grow, and after
    ``retries`` it is parked. The audit has a row for each (document, dimension) and each parked document.
    """
    actions, rejects = facts.validate_replies(replies)
    answered = facts.accepted_replies(replies, rejects)
    applied = facts.apply_actions(entries, actions, now=now, answered=answered)
    outcomes = cut_lineage(facts.reply_outcomes(applied, rejects))  # a few columns, read three times
    after = state.apply_outcomes(docs, outcomes, retries)
    audit = state.classify_audit(outcomes, correlation_id, now).unionByName(state.parked_audit(docs, after, correlation_id, now))
    return ClassifyPass(after, applied.entries, applied.links, outcomes, rejects, audit)
