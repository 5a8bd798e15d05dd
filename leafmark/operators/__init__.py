"""leafmark.operators"""
