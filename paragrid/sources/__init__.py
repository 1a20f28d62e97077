"""paragrid.sources"""
