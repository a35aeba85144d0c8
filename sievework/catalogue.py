"""Names of the queries over the driver's tables, with their oracle SQL."""

from sievework.plans import models, rules, selection, tables, text

QUERIES: dict = selection.QUERIES | text.QUERIES | models.QUERIES | rules.QUERIES | tables.QUERIES
ORACLES: dict = selection.ORACLES | text.ORACLES | models.ORACLES | rules.ORACLES | tables.ORACLES
