"""textmill.operators"""
