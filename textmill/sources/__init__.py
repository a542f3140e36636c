"""textmill.sources"""
