"""shelfspark.operators"""
