"""leafmark.sources"""
