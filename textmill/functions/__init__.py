"""textmill.functions"""
