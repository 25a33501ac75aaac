"""The same analyses as plain SQL over the star tables, for checking.

Independent of the Spark plans: it expands the fact row by row and uses plain
windows, joins and exact aggregates. Only names and texts that both sides must
spell alike come from ``rentlens.functions.labels``.
"""

from oracle import regression, statements

STATEMENTS = statements.STATEMENTS | regression.STATEMENTS

__all__ = ["STATEMENTS"]
