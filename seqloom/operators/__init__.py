"""seqloom.operators"""
