"""confero.functions"""
