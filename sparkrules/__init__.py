"""Rules and column derivation over DataFrames.

Rules (patterns, joins, negation, aggregation, temporal conditions) compile to
DataFrame plans; a thin driver chains them to quiescence with priorities and
truth maintenance.
"""

from sparkrules.functions.exprs import col, lit
from sparkrules.operators.session import RuleSession, about, run
from sparkrules.plans.builder import Rule
from sparkrules.plans.drl import parse
from sparkrules.sources.facts import FactType, event, fact

__all__ = ["FactType", "Rule", "RuleSession", "about", "col", "event", "fact", "lit", "parse", "run"]
