"""paragrid.functions"""
