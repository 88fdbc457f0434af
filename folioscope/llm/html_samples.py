"""Pieces of labelled pages from which the costs of html_extract are fitted.

{text} stands before each block of an article; pieces without it are outside one. {content} and {other} are where pieces go.
"""

#: The article's pieces.
CONTENT = [
    "<p>{text}The river rose by two metres in the night, and by the morning the lower streets were under water.</p>",
    "<p>{text}Nobody had expected the bridge to hold. It did.</p>",
    "<p>{text}She shrugged.</p>",
    "{text}Some old pages have no marks at all around their text, only a line break here and there.<hr>",
    "<p>{text}The page that you see was written by hand, long before there were any programs for it.",
    "<p>{text}“We will build it again,” the mayor said on Tuesday, “and we will build it higher than before.”</p>",
    "<p>{text}The method has three steps, which are described in <a href='/s'>an earlier paper</a> and are only summed up here.</p>",
    "<p>{text}According to <a href='#'>the report</a>, prices went up by four per cent last year, while wages hardly moved at all in most of the country.</p>",
    "<h1>{text}Flood in the valley</h1>",
    "<h2>{text}What happened next</h2>",
    "<h2>{text}Results</h2>",
    "<h3>{text}1.2 Search trees</h3>",
    "<ul><li>{text}two eggs</li><li>{text}a cup of flour</li><li>{text}Salt and pepper to taste.</li></ul>",
    "<ol><li>{text}Heat the oven to 180 degrees and butter a tin.</li><li>{text}Mix all that is dry.</li></ol>",
    "<ul><li>{text}<a href='/wiki/a'>Breadth first</a> looks at near nodes before far ones.</li><li>{text}<a href='/wiki/b'>Depth first</a></li></ul>",
    "<blockquote>{text}There is no royal road to geometry.</blockquote>",
    "<blockquote><p>{text}It was the best of times, it was the worst of times, and nobody could tell which.</p></blockquote>",
    "<pre>{text}for i in range(10): print(i)</pre>",
    "<table><tr><th>{text}Year</th><th>{text}Rainfall</th></tr><tr><td>{text}1998</td><td>{text}812 mm</td></tr></table>",
    "<figure><img src='x.png'><figcaption>{text}The old mill in spring, seen from the church.</figcaption></figure>",
    "<div>{text}Some pages set their paragraphs in plain divisions, one after the other, as this one does.</div>",
    "<div class='text'><p>{text}The court held that the statute applies to works made before it came into force.</p></div>",
    "<section id='search'><h2>{text}Search</h2><p>{text}A search algorithm finds an item with given properties among a collection of items.</p></section>",
    "<section id='legal'><p>{text}Under the law of that time a widow could keep the house, but not the land around it.</p></section>",
    "<div class='copyright-law'><p>{text}Copyright protects the form of a work and never the idea behind it, as the judges said twice.</p></div>",
    "<p class='notice'>{text}Take care not to let the mixture boil, since it spoils the taste within a minute or two.</p>",
    "<p class='alert-box'>{text}Readers should note that these figures were changed after the first edition of the book.</p>",
    "<section class='header-section'><p>{text}The header of a packet names its sender, its receiver and the number of bytes that follow.</p></section>",
    "<dl><dt>{text}Node</dt><dd>{text}A point of the graph that may have any number of edges.</dd></dl>",
    "<header><h1>{text}How trees grow</h1><p>{text}A tree puts on one ring a year, wide or narrow as the weather has been.</p></header>",
]

#: What stands around articles.
BOILERPLATE = [
    "<nav><ul><li><a href='/'>Home</a></li><li><a href='/news'>News</a></li><li><a href='/about'>About us</a></li></ul></nav>",
    "<div class='menu'><a href='/a'>Sport</a> <a href='/b'>Weather</a> <a href='/c'>Money</a></div>",
    "<ul class='nav-links'><li><a href='/x'>Contact</a></li><li><a href='/y'>Press</a></li></ul>",
    "<div class='breadcrumbs'><a href='/'>Start</a> &gt; <a href='/k'>Kitchen</a> &gt; Cakes</div>",
    "<header><div>The Daily Valley</div><p>News for all who live by the river, every day since 1890.</p></header>",
    "<div id='header'><p>The Daily Valley</p></div>",
    "<div id='site-header' class='header'><h2>Valley News</h2><p>All that is worth knowing, every single morning of the year.</p></div>",
    "<footer><p>© 2019 Valley Press. All rights reserved.</p><p><a href='/i'>Imprint</a> | <a href='/p'>Privacy</a></p></footer>",
    "<footer>© 2021 valley.example. All that stands here was written by people who live in the valley. Write to us if you know more than we do. We answer every letter.</footer>",
    "<footer><div>© The Mill</div><p>The Mill is a small house for books, music and bread. It is open from Monday to Friday and on every first Saturday of the month, but never in August.</p></footer>",
    "<aside><p>The author has lived in the mountains for ten years. She keeps bees, mends clocks and writes a column for this paper on the first day of each month.</p></aside>",
    "<nav><p>You are reading part two of a series about rivers. Part one was about springs, and part three, which will come out next week, is about the sea.</p></nav>",
    "<div class='footer'><p>Copyright Valley Press. No part of this site may be used without our leave in writing.</p></div>",
    "<div id='legal'><p>All names on this site are trade marks of those who own them.</p></div>",
    "<aside><h3>Most read</h3><ul><li><a href='/1'>Mayor resigns</a></li><li><a href='/2'>Ten cakes for the winter</a></li></ul></aside>",
    "<div class='sidebar'><h3>About me</h3><p>I write about trees and rivers, and sometimes about the people who live near them.</p></div>",
    "<div class='related'><h3>Related</h3><p><a href='/r'>Why rivers rise in spring</a></p></div>",
    "<div class='ad'>Buy two pairs of shoes today and get the third one for nothing at all!</div>",
    "<div class='ad'>Our new oven bakes bread, cakes and pies in half the time that you are used to, and it cleans itself, so that you can sit down with your guests.</div>",
    "<div class='ads'><p>Cheap flights to the south from tomorrow on. Book now, pay later, and take a friend with you for half the price!</p></div>",
    "<div id='ad-top'>Fresh coffee.</div>",
    "<div class='advertisement'><p>Save up to 40 per cent on your next insurance. Ask for our offer now.</p></div>",
    "<div class='promo-box sponsored'><p>Our partner gives you a month of films for free if you sign up this week.</p></div>",
    "<div id='cookie-notice'><p>We use cookies to make this site better for you. By reading on you agree to that.</p><button>OK</button></div>",
    "<div class='notice'>This site needs scripts. Please turn them on in your browser.</div>",
    "<div class='alert'><p>Our office is closed on Monday.</p></div>",
    "<form action='/s'><label>Search</label><input name='q'><button>Go</button></form>",
    "<form><p>Please enter your mail address here to get our letters each week.</p></form>",
    "<div class='newsletter'><p>Get the best of our stories each week, straight into your mail box.</p></div>",
    "<div class='share'><a href='/f'>Share</a> <a href='/t'>Tweet</a></div>",
    "<div id='comments'><h3>3 comments</h3><div class='comment'><p>I liked this article so much that I read it twice today.</p></div><div class='comment'><p>Me too.</p></div></div>",
    "<section class='comments'><article><p>Reader: the second figure can not be right, since the mill was built much later.</p></article></section>",
    "<div class='pagination'><a href='?2'>2</a> <a href='?3'>3</a> <a href='?n'>Next</a></div>",
    "<div style='display:none'><p>This text is never shown to any reader of the page, whatever they do.</p></div>",
    "<p><a href='/back'>Back to the top</a></p>",
    "<div><a href='/l'>Log in</a> or <a href='/r'>register</a></div>",
    "<ul><li><a href='/q'>Questions</a></li><li><a href='/j'>Jobs</a></li><li><a href='/m'>Map</a></li></ul>",
    "<p>Tel. 030 1234</p>",
    "<div>Loading...</div>",
]

#: Pages around both.
FRAMES = [
    "<html><body>{other}<article>{content}</article>{other}</body></html>",
    "<html><body>{other}<main>{content}</main>{other}</body></html>",
    "<html><body>{other}<article>{content}{other}</article>{other}</body></html>",
    "<html><body>{other}<div class='wrap'><div class='main-content header-fixed'>{content}</div>{other}</div>{other}</body></html>",
    "<html><body>{other}<div id='content'>{content}</div>{other}</body></html>",
    "<html><body><div><div>{other}</div><div class='post-body'>{content}</div></div>{other}</body></html>",
    "<html><body>{other}<div>{content}</div>{other}</body></html>",
    "<html><body><div class='page'>{other}<div class='c7'><div>{content}</div></div>{other}</div></body></html>",
    "<html><body>{content}</body></html>",
    "<body>{content}",
    "{content}",
]
