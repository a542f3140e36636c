"""textmill.streaming"""
