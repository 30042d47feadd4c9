"""confero.plans"""
