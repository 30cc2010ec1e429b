"""Dictionary enrichment, standardised PCA and chart-ready summary tables on Spark."""
