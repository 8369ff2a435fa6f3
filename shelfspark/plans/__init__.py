"""shelfspark.plans"""
