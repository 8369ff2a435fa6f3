"""shelfspark.streaming"""
