"""shelfspark.sources"""
