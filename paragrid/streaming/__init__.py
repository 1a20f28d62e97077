"""paragrid.streaming"""
