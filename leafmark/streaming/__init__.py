"""leafmark.streaming"""
