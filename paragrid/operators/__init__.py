"""paragrid.operators"""
