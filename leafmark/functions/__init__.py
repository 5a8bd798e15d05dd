"""leafmark.functions"""
