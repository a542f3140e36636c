"""textmill.plans"""
