"""riskweave: credit-portfolio analytics and default scoring on Spark."""

__version__ = "0.1.0"
