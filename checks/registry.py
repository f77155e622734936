"""All registered queries, in the order of the operator inventory."""

from checks import suite_sources, suite_operators, suite_products  # noqa: F401
from checks.suite import ORACLE, QUERIES  # noqa: F401
