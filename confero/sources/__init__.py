"""confero.sources"""
