"""confero.streaming"""
