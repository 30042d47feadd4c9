"""confero.operators"""
