"""Forecasters: each fits parameter tables with Spark aggregations and scores rows with them."""
