"""paragrid.plans"""
